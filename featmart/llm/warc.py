"""WARC archives: write pages as records, read archives back by boundary-chain verification.

Writing: one record per row through Spark's text writer, whose line separator is the record's closing
CRLF CRLF, so any file system and the usual commit protocol will do. The payload is the HTML in UTF-8
behind an HTTP head. Of rows with equal payloads of at least ``MIN_REVISIT`` bytes those with the largest
page id are responses and the others revisits that refer to it; smaller ones are all responses.

Reading: the files are split at the magic line ``WARC/1.0`` over many tasks; each piece behind a magic is
a candidate record whose header names its successor's offset. The magic may stand in a payload, so a
candidate counts only if the chain of successors from the start of its file reaches it. Candidates of one
block follow the chain inside the block first, which leaves one exit per candidate; pointer jumping over
the blocks' entries (each round doubles the pointers) finds the entries reached from the file's start;
each block then marks what lies on the chain from its entry. Pieces that a payload's magic split are put
together again. A chain that hits an offset without a candidate ends there.

The files are read twice: for the chain (lengths, headers and a 128-bit hash of every piece, numbered once and written),
and for the payloads. How files are split may differ between the reads, as it follows the number of cores, so pieces are
matched by their hash: equal pieces are interchangeable, and of a hash as many are kept as are verified. Nearly all
pieces are whole verified records; only the others' hashes are looked up, so payloads are not shuffled. ``resolve``
fails if the records read are not as many as those verified.

Odd rows: null HTML is an empty payload; a null URL is an empty header, line ends in it are
percent-encoded; a null page id is written as an empty id, takes no part in naming a response and is a
revisit if an equal payload has an id. Rows with the same id and payload get the same type. An empty
table writes no record. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featmart.llm.common import materialise, shared_path, small

MIN_REVISIT = 1000
# fixed values: the format's marks
MAGIC = "WARC/1.0\r\n"
CLOSE = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_M = len(MAGIC)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to); refers_to is null for responses."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    again = materialise(p.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes")
                        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
                        .select("digest", "bytes", "first"), "repeated")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    return p.join(small(again), ["digest", "bytes"], "left").select("page_id", "url", "payload", "digest", "bytes", first.alias("refers_to"))


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write ``plan_records`` rows as WARC files below ``path``."""
    again = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(again, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                               _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(CLOSE), block)
    records.select(line.alias("value")).write.option("lineSep", CLOSE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics: (file, block, mid, size, value, h1, h2). ``mid`` orders the pieces of a block, in one
    evaluation of the plan only."""
    v = F.col("value")
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), F.col("_metadata.file_size").alias("size"), "value",
        F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))


def _span(head: Column, value: Column) -> Column:
    """Bytes from a piece's start to its record's end, as its header says; null without a readable header."""
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length: *([0-9]{1,15})(?:\r\n|$)", 1)
    return F.when((F.instr(value, CLOSE) > 0) & (length != ""), F.octet_length(head) + 8 + length.cast("long"))


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, mid, i, off, succ, size, h1, h2): every piece with its own offset, that of the magic before it (negative
    for what precedes a file's first magic), and its successor's; ``i`` numbers the pieces of a file; ``succ`` is null
    without a readable header."""
    n = materialise(pieces.select("file", "block", "mid", "size", F.octet_length("value").cast("long").alias("n"),
                                  _span(F.substring_index("value", CLOSE, 1), F.col("value")).alias("span"), "h1", "h2"), "pieces")
    per_block = n.groupBy("file", "block").agg(F.sum(F.col("n") + _M).alias("b"), F.count(F.lit(1)).alias("c"))
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(per_block.select("file", "block", F.coalesce(F.sum("b").over(prior), F.lit(0)).alias("b0"),
                                          F.coalesce(F.sum("c").over(prior), F.lit(0)).alias("c0")), "blocks")
    inside = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    at = n.select("*", F.coalesce(F.sum(F.col("n") + _M).over(inside), F.lit(0)).alias("b1"),
                  F.coalesce(F.count("mid").over(inside), F.lit(0)).alias("c1")).join(blocks, ["file", "block"])
    off = F.col("b0") + F.col("b1") - _M
    return at.select("file", "block", "mid", (F.col("c0") + F.col("c1")).alias("i"), off.alias("off"),
                     (off + _M + F.col("span")).alias("succ"), "size", "h1", "h2")


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block, the first offset on its chain that is none of the block's candidates."""
    succ = dict(zip(g["off"], g["succ"]))
    out: dict[int, int] = {}
    for off in sorted(succ, reverse=True):
        nxt = succ[off]
        out[off] = out.get(nxt, nxt) if nxt > off else -1
    return g.assign(exit=g["off"].map(out))


def _on_chain(g: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block on the chain from its entry."""
    succ, at, hit = dict(zip(g["off"], g["succ"])), int(g["entry"].iloc[0]), set()
    while at in succ and at not in hit:
        hit.add(at)
        at = succ[at]
    return g[g["off"].isin(hit)].drop(columns="entry")


def reachable(cand: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches, as (file, block, mid, i, off, succ, size)."""
    known = cand.where("succ is not null and off >= 0").select("file", "block", "mid", "i", "off", "succ", "size")
    kinds = "file string, block long, mid long, i long, off long, succ long, size long"
    local = materialise(known.groupBy("file", "block").applyInPandas(_exits, kinds + ", exit long"), "exits")
    # entries: file starts and offsets that another block exits to
    doors = local.select("file", F.col("exit").alias("off")).where("off >= 0").distinct().unionAll(
        local.where("off = 0").select("file", "off")).distinct()
    ptr = materialise(local.join(doors, ["file", "off"], "left_semi").select("file", "off", "exit"), "doors")
    reached = materialise(ptr.where("off = 0").select("file", "off"), "reached")
    grown, size = True, reached.count()
    while grown:
        onward = reached.join(ptr, ["file", "off"]).select("file", F.col("exit").alias("off"))
        reached = materialise(reached.unionAll(onward.join(ptr, ["file", "off"], "left_semi")).distinct(), "reached")
        ptr = materialise(ptr.join(ptr.select("file", F.col("off").alias("exit"), F.col("exit").alias("far")), ["file", "exit"], "left")
                          .select("file", "off", F.coalesce("far", "exit").alias("exit")), "doors")
        grown, size = (now := reached.count()) > size, now
    entry = local.join(reached, ["file", "off"], "left_semi").groupBy("file", "block").agg(F.min("off").alias("entry"))
    return local.drop("exit").join(entry, ["file", "block"]).groupBy("file", "block").applyInPandas(_on_chain, kinds)


@dataclass
class Records:
    """``rows``: one per record (page_id, url, type, digest, refers_to, payload, intact); ``verified``: how many there are."""
    rows: DataFrame
    verified: int


def read_archives(spark: SparkSession, path: str) -> Records:
    """The verified records. ``digest`` is the one that the header states; ``intact``: the record has the length that its
    header states."""
    cand = materialise(candidates(_pieces(spark, path)), "candidates")
    good = materialise(reachable(cand), "records")
    after = cand.select("file", F.col("off").alias("succ"), F.col("i").alias("j"))
    # the last piece of each record: the one before its successor, or the file's last
    last = cand.groupBy("file").agg((F.max("i") + 1).alias("end"))
    known = good.join(after, ["file", "succ"], "left").join(last, "file").select(
        "file", "i", (F.col("succ") - F.col("off") - _M).alias("stated"), F.coalesce("j", "end").alias("j"))
    known = materialise(known, "spans")
    # pieces by hash: how often in the files, and how often as a whole verified record
    whole = cand.join(known.where("j = i + 1").select("file", "i", F.lit(1).alias("one")), ["file", "i"], "left")
    by_hash = whole.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("v"))
    special = materialise(by_hash.where("v < n").select("h1", "h2", "v"), "special")
    torn = materialise(known.where("j > i + 1"), "torn")
    parts = torn.select(F.col("i").alias("rec"), "stated", "file", F.explode(F.sequence("i", F.col("j") - 1)).alias("i")).join(
        cand.select("file", "i", "h1", "h2"), ["file", "i"])
    parts = materialise(parts.select("file", "rec", "stated", "i", "h1", "h2"), "parts")
    values = _pieces(spark, path).select("value", "h1", "h2")
    hashes = special.select("h1", "h2", "v")
    one = values.join(small(hashes.select("h1", "h2")), ["h1", "h2"], "left_anti")
    stated = _span(F.substring_index("value", CLOSE, 1), F.col("value"))
    texts = values.join(small(hashes), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    again = texts.where("v > 0").select("value", F.explode(F.sequence(F.lit(1).cast("long"), "v"))).select("value")
    put = texts.join(parts, ["h1", "h2"]).groupBy("file", "rec", "stated").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("v"))
    mended = put.select(F.array_join(F.transform("v", lambda x: x["value"]), MAGIC).alias("value"), "stated")
    rec = one.select("value", stated.alias("stated")).unionByName(again.select("value", stated.alias("stated"))).unionByName(mended)
    head = F.substring_index("value", CLOSE, 1)
    body = F.expr(f"substr(value, instr(value, '{CLOSE}') + 4)".replace("\r", "\\r").replace("\n", "\\n"))
    block = F.expr("substr(body, 1, length(body) - 4)")
    payload = F.expr("substr(block, instr(block, '\\r\\n\\r\\n') + 4)")

    def field(name: str, pattern: str = ".*") -> Column:
        return F.regexp_extract("head", rf"(?:^|\r\n){name}: ({pattern})(?:\r\n|$)", 1)

    def page(name: str) -> Column:
        return F.regexp_extract(field(name), r"^<urn:page:(-?[0-9]+)>$", 1)

    def number(c: Column) -> Column:
        return F.when(c != "", c.cast("long"))

    rows = rec.withColumns({"head": head, "body": body}).withColumns({"block": block}).select(
        number(page("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI", "[^\\r\\n]*").alias("url"), field("WARC-Type", "[a-z]*").alias("type"),
        field("WARC-Payload-Digest", "sha1:[0-9a-f]*").substr(F.lit(6), F.lit(64)).alias("digest"), number(page("WARC-Refers-To")).alias("refers_to"),
        payload.alias("payload"), (F.octet_length("value") == F.col("stated")).alias("intact"))
    return Records(rows, known.count())


def resolve(records: Records) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): size and digest of responses from
    their payload, of revisits from the response that they refer to (null if the archives lack it)."""
    narrow = materialise(records.rows.select("page_id", "type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("n"),
                                        F.sha1("payload").alias("actual")), "resolved")
    read = narrow.count()
    if read != records.verified:
        raise RuntimeError(f"{records.verified} records verified, {read} read: the archives changed between the reads")
    own = narrow.where("type = 'response'")
    target = own.where("page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("actual").alias("digest"), F.col("n").alias("m")).distinct()
    back = narrow.where("type = 'revisit'").join(target, ["refers_to", "digest"], "left")
    return own.select("page_id", F.col("n").alias("payload_bytes"), F.col("actual").alias("payload_digest"), F.col("type").alias("record_type"),
                      F.lit(None).cast("long").alias("refers_to")).unionByName(
        back.select("page_id", F.col("m").alias("payload_bytes"), F.when(F.col("m").isNotNull(), F.col("digest")).alias("payload_digest"),
                    F.col("type").alias("record_type"), "refers_to"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(plan_records(pages), path)
    return resolve(read_archives(pages.sparkSession, path))
