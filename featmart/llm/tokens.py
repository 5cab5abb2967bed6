"""Token counts by prefix dynamic programming.

For every prefix (in code points) of a text the operator stores how many tokens the library would give
for that prefix alone, so truncation and budget questions are answered from the stored table without
encoding again. Files: byte-level BPE of the ``tokenizers`` library with its usual pre-tokenizer.

Inside one piece of the pre-tokenizer the counts come from a dynamic programme over its bytes: the last
token of a prefix is the one vocabulary entry ``t`` that ends there and forms, with the last token of
the prefix before it, a pair that the merges leave as it is. Pieces recur, so their prefix counts are
kept in bounded tables per worker, as are whole words and the
starts of pieces. Counts are stored as differences from prefix to prefix; those of a text are the
differences of its pieces one behind the other, so a slice of texts is split, its words numbered and their
differences gathered as Arrow columns, and Python sees each different word once. They are corrected
where a shorter text would be cut into other pieces: at the end of a run of white space, inside the
endings like 'll, and inside a special string. Special strings whole in a text are one token each, as
the library does by default.

A null text counts as empty: 0 tokens, no prefixes. Null ids, repeated rows and extra columns pass.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.llm.common import map_batches

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
# fixed values: the byte-level pre-tokenizer's pattern and its endings
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# texts whose white space is not single blanks and line ends between words
_ODD_SPACE = (r"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STEMS = (10, 7, 4)
#: Pieces, words, stems and token pairs that a worker remembers, once young and once old.
REMEMBER = 250_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _newer_letters() -> regex.Pattern:
    """Letters and numbers that are younger than Python's own Unicode tables."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd = [ord(m[0]) for m in regex.finditer(r"[\p{L}\p{N}]", every) if unicodedata.category(m[0])[0] not in "LN"]
    runs = []
    for c in odd:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


class Memory:
    """A table of about ``size`` to twice ``size`` entries: when the young half is full it becomes the old
    half, and what is still in use moves back, so frequent entries stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()           # the same dict, as callers hold its ``get``
        self.young[key] = value
        return value


class PrefixCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.ids = self.tok.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.ids))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = _byte_letters()
        self.pieces, self.words = Memory(REMEMBER), Memory(REMEMBER)     # text to (tokens, differences)
        self.stems = Memory(REMEMBER // 3)      # start of a piece to (counts, nodes, start of its last token)
        self.nodes: dict[str, dict] = {}        # token to {0: token, token behind it: that one's node or False}
        self.known_pairs = 0
        self.pattern, self.newer = regex.compile(PIECES).findall, _newer_letters()

    def find(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces. The library's own Unicode tables decide where a text has characters
        that the regular expressions here may class otherwise."""
        if text.isascii() or not self.newer.search(text):
            return self.pattern(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _next(self, node: dict, t: str) -> dict | None:
        """The node of token ``t`` if it can stand behind the node's token (or begin a piece), else None."""
        if t not in self.ids:
            return None
        if self.known_pairs >= REMEMBER:
            self.nodes.clear()
            self.known_pairs = 0
        a = node[0]
        fits = [x.value for x in self.tok.model.tokenize(a + t)] == ([a, t] if a else [t])
        node[t] = self.nodes.setdefault(t, {0: t}) if fits else False
        self.known_pairs += 1
        return node[t] or None

    def _byte_prefixes(self, s: str) -> list[int]:
        """Tokens of s[:j] for every j, s in the byte alphabet."""
        count, last, start = [0], [self.nodes.setdefault("", {0: ""})], 0
        further, ids = self._next, self.ids
        for k in STEMS:             # many pieces begin alike
            if len(s) > k and (stem := self.stems.get(s[:k])):
                count, last, start = stem[0][:], stem[1][:], stem[2]
                break
        for j in range(len(count), len(s) + 1):
            # only one start fits; where the token before began is the likeliest, then the last byte alone
            i, t = start, s[start:j]
            node = last[i].get(t)
            if node is None:
                node = further(last[i], t)
            if not node:
                i, t = j - 1, s[j - 1]
                node = last[i].get(t)
                if node is None:
                    node = further(last[i], t)
                if not node:
                    for i in range(j - 2, max(0, j - self.longest) - 1, -1):
                        t = s[i:j]
                        node = last[i].get(t)
                        if node is None and t in ids:
                            node = further(last[i], t)
                        if node:
                            break
                    else:
                        raise ValueError(f"no token ends at byte {j} of {s[:40]!r}")
            count.append(count[i] + 1)
            last.append(node)
            start = i
            if j in STEMS and j < len(s):
                self.stems.put(s[:j], (count[:], last[:], start))
        return count

    def piece(self, w: str) -> tuple[int, bytes | np.ndarray]:
        """Tokens of a piece, and the differences of its prefix counts: bytes if each fits one."""
        got = self.pieces.get(w)
        if got is None:
            n = self._byte_prefixes(w.encode().decode("latin-1").translate(self.letters))
            if not w.isascii():
                ends, at = [0], 0
                for c in w:
                    at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                    ends.append(at)
                n = [n[i] for i in ends]
            if w in ENDINGS:     # cut short, an ending is an apostrophe and letters
                n = [0] + [1 + len(self.tok.encode(w[1:j]).ids) if j > 1 else 1 for j in range(1, len(w))] + [n[-1]]
            d = list(map(int.__sub__, n[1:], n))
            try:
                data = array("b", d).tobytes()
            except OverflowError:
                data = np.array(d, np.int64)
            got = self.pieces.put(w, (n[-1], data))
        return got

    def word(self, w: str) -> tuple[int, bytes | np.ndarray]:
        """As ``piece``, for a word of a plainly spaced text: behind a NUL the first one, else behind its line
        end or a blank."""
        if w.isalpha():
            return self.piece(" " + w)
        got = self.words.get(w)
        if got is None:
            known, learn = self.pieces.young.get, self.piece
            parts = [known(p) or learn(p) for p in self.find(w[1:] if w[0] == "\0" else w if w[0] == "\n" else " " + w)]
            if all(type(d) is bytes for _, d in parts):
                data = b"".join([d for _, d in parts])
            else:
                data = np.concatenate([_wide(d) for _, d in parts])
            got = self.words.put(w, (sum([n for n, _ in parts]), data))
        return got

    def _plain(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Prefix counts of a text without special strings, its pieces and the tokens before each."""
        words = self.find(text)
        if not words:
            return np.empty(0, np.int64), words, np.empty(0, np.int64)
        got = [self.piece(w) for w in words]
        totals = np.array([g[0] for g in got], np.int64)
        before = np.cumsum(totals) - totals
        starts = np.cumsum([0, *map(len, words[:-1])])
        out = np.cumsum(np.concatenate([_wide(d) for _, d in got]))
        for i, w in enumerate(words[:-1]):
            if w.isspace() and words[i + 1][0].isspace():
                out[starts[i + 1]] = before[i] + self.piece(w + words[i + 1][0])[0]
        return out, words, before

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:1], text[:2], ..., text."""
        if not text:
            return np.empty(0, np.int64)
        parts, total, at = [], 0, 0
        marks = list(self.special.finditer(text)) if self.special else []
        for m in [*marks, None]:
            end = m.start() if m else len(text)
            words, before, base = [], np.empty(0, np.int64), total
            if end > at:
                out, words, before = self._plain(text[at:end])
                parts.append(out + total)
                total += int(out[-1])
            if m:
                # the mark cut short is ordinary text behind the last piece that is not white space
                i = len(words)
                while i and words[i - 1].isspace():
                    i -= 1
                i = max(0, i - 1)
                tail, done = "".join(words[i:]), int(before[i]) if words else 0
                inside = [base + done + int(self._plain(tail + m[0][:j])[0][-1]) for j in range(1, len(m[0]))]
                total += 1
                parts.append(np.array([*inside, total], np.int64))
                at = m.end()
        return np.concatenate(parts)

    def table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Tokens, width and packed differences of each text (null: empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n, width, deltas = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int32), [b""] * len(texts)
        odd = _ODD_SPACE + (f"|{self.special.pattern}" if self.special else "")
        simple = pc.and_(pc.invert(pc.match_substring_regex(texts, odd)), pc.not_equal(texts, "")).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(simple)
        slow = np.flatnonzero(~simple).tolist()
        if len(at):
            # first words carry a NUL, which none of these texts holds; a line end opens its word
            marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(texts.take(pa.array(at)), "\n", " \n"),
                                                 pa.scalar("", pa.large_string()))
            split = pc.split_pattern(marked, " ")
            bounds = np.asarray(split.offsets).astype(np.int64)
            coded = split.flatten().dictionary_encode()
            code = np.asarray(coded.indices)
            known, learn = self.words.young.get, self.word
            got = [known(w) or learn(w) for w in coded.dictionary.to_pylist()]
            wide = np.array([type(d) is not bytes for _, d in got])
            totals = np.fromiter((t for t, _ in got), np.int64, len(got))[code]
            n[at] = np.add.reduceat(totals, bounds[:-1])
            data = pa.array([b"" if w else d for w, (_, d) in zip(wide, got)], pa.large_binary()).take(coded.indices)
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1][bounds]
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.tobytes()), data.buffers()[2]])
            for i, d in zip(at.tolist(), joined.to_pylist()):
                deltas[i] = d
            if wide.any():
                slow += at[np.logical_or.reduceat(wide[code], bounds[:-1])].tolist()
        for i in slow:
            counts = self.prefixes(texts[i].as_py())
            n[i] = counts[-1] if len(counts) else 0
            width[i], deltas[i] = pack(counts)
        return n, width, pa.array(deltas, pa.binary())


def _wide(d: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(d, np.int8).astype(np.int64) if type(d) is bytes else d


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack(counts: np.ndarray) -> tuple[int, bytes]:
    """Differences from prefix to prefix in the narrowest of 1, 2 or 4 bytes."""
    d = np.diff(counts, prepend=0)
    for width in (1, 2):
        half = 1 << (8 * width - 1)
        if not len(d) or (d.min() >= -half and d.max() < half):
            return width, d.astype(f"<i{width}").tobytes()
    return 4, d.astype("<i4").tobytes()


def unpack(width: int, deltas: bytes) -> np.ndarray:
    """Tokens of every prefix, from the empty one to the whole text."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(deltas, f"<i{width}"), dtype=np.int64)))


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, width, deltas) per row: the stored prefix counts. ``path`` names the
    tokenizer file at the same place on every node."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                      F.col(text_col).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, width, deltas = counter(path).table(b.column("text"))
        return pa.record_batch([b.column("id"), b.column("n_bytes"), pa.array(n), pa.array(width), deltas],
                               names=["id", "n_bytes", "n_tokens", "width", "deltas"])

    return map_batches(src, run, src.drop("text").schema.add("n_tokens", "long").add("width", "integer").add("deltas", "binary"))


def answer(table: DataFrame, budget: int | None = None, chars: int | None = None) -> DataFrame:
    """From stored counts: ``cut``, the longest prefix (code points) of at most ``budget`` tokens, and
    ``tokens``, the count of the first ``chars`` code points (of the whole text if it is shorter)."""
    src = table.select("id", "width", "deltas")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cut, tokens = [], []
        for w, d in zip(b.column("width").to_pylist(), b.column("deltas").to_pylist()):
            n = unpack(w, d)
            cut.append(None if budget is None else int(np.flatnonzero(n <= budget)[-1]) if budget >= 0 else 0)
            tokens.append(None if chars is None else int(n[min(chars, len(n) - 1)]))
        return pa.record_batch([b.column("id"), pa.array(cut, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "cut", "tokens"])

    return map_batches(src, run, src.select("id").schema.add("cut", "long").add("tokens", "long"))
