"""DuckDB SQL for supervised bins, by other means than the library's: every way to cut the pre-bins into bins
is listed by a recursive query, and the best of all is picked."""

from __future__ import annotations

from collections.abc import Sequence

from featmart.operators.encode import WOE_EPS


def numeric_long(src: str, nums: Sequence[str], key: str) -> str:
    """(key, y, feature, x) rows of the numeric columns."""
    items = ", ".join(f"{{'f': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in nums)
    return f"SELECT {key}, y, u.f AS feature, u.x AS x FROM (SELECT {key}, y, unnest([{items}]) AS u FROM {src})"


def text_long(src: str, cats: Sequence[str], key: str) -> str:
    """(key, y, feature, v) rows of the string columns."""
    items = ", ".join(f"{{'f': '{c}', 'v': CAST({c} AS VARCHAR)}}" for c in cats)
    return f"SELECT {key}, y, u.f AS feature, u.v AS v FROM (SELECT {key}, y, unnest([{items}]) AS u FROM {src})"


def _bin_of(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR len(edges) = 0 OR {x} < edges[1] OR {x} > edges[len(edges)] THEN NULL "
            f"WHEN {x} = edges[1] THEN 0 ELSE CAST(len(list_filter(edges, lambda e: e < {x})) - 1 AS INTEGER) END")


def bins_ctes(src: str, nums: Sequence[str], cats: Sequence[str], key: str, prebins: int, min_share: float, tag: str = "") -> str:
    """CTEs over ``src`` (key, y and the columns): ``edges<tag>`` (feature, edges), ``placed<tag>`` (key, y, feature, pre:
    the pre-bin of every row), ``bins<tag>`` (feature, bin, first, last, count, events, woe, iv)."""
    probs = "[" + ", ".join(repr(i / prebins) for i in range(prebins + 1)) + "]"
    e = f"{WOE_EPS}::DOUBLE"
    parts = [f"""nl{tag} AS ({numeric_long(src, nums, key)}),
edges{tag} AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {probs}))) AS edges FROM nl{tag} WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1),
np{tag} AS (SELECT {key}, y, nl{tag}.feature, {_bin_of('x')} AS pre FROM nl{tag} LEFT JOIN edges{tag} USING (feature)),
ne{tag} AS (SELECT feature, unnest(range(0, greatest(1, len(edges) - 1))) AS pre FROM edges{tag})"""]
    pre = f"""SELECT ne{tag}.feature, ne{tag}.pre, count(p.pre) AS count, coalesce(sum(p.y), 0) AS events
  FROM ne{tag} LEFT JOIN (SELECT * FROM np{tag} WHERE y IS NOT NULL) p ON p.feature = ne{tag}.feature AND p.pre = ne{tag}.pre GROUP BY 1, 2"""
    placed = f"SELECT {key}, y, feature, pre FROM np{tag}"
    if cats:
        parts.append(f"""tl{tag} AS ({text_long(src, cats, key)}),
tc{tag} AS (SELECT feature, v, count(*) AS count, sum(y) AS events FROM tl{tag} WHERE y IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
tr{tag} AS (SELECT *, count(*) OVER (PARTITION BY feature) AS n, row_number() OVER (PARTITION BY feature ORDER BY events / count, v) AS rn,
  sum(count) OVER (PARTITION BY feature ORDER BY events / count, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  sum(count) OVER (PARTITION BY feature) AS allrows FROM tc{tag}),
tp{tag} AS (SELECT feature, v, count, events, CAST(CASE WHEN n <= {prebins} THEN rn - 1 ELSE floor((cum - count / 2) * {prebins} / allrows) END AS INTEGER) AS pre FROM tr{tag})""")
        pre += f"\n  UNION ALL SELECT feature, pre, sum(count), sum(events) FROM tp{tag} GROUP BY 1, 2"
        placed += f" UNION ALL SELECT t.{key}, t.y, t.feature, tp{tag}.pre FROM tl{tag} t LEFT JOIN tp{tag} ON t.feature = tp{tag}.feature AND t.v = tp{tag}.v"
    parts.append(f"""pre{tag} AS ({pre}),
placed{tag} AS ({placed}),
seq{tag} AS (SELECT feature, pre, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY feature) AS n,
  sum(count) OVER w AS c, sum(events) OVER w AS ev, sum(count) OVER (PARTITION BY feature) AS rows, sum(events) OVER (PARTITION BY feature) AS evs,
  count AS own, events AS own_ev FROM pre{tag} WINDOW w AS (PARTITION BY feature ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seg{tag} AS (SELECT a.feature, a.pos AS i, b.pos + 1 AS j, a.pre AS first, b.pre AS last, b.c - a.c + a.own AS cnt, b.ev - a.ev + a.own_ev AS ev, a.n
  FROM seq{tag} a JOIN seq{tag} b ON a.feature = b.feature AND a.pos <= b.pos
  WHERE b.c - a.c + a.own >= {min_share} * a.rows AND b.c - a.c + a.own > 0),
walk{tag} AS (SELECT feature, dir, CAST(0 AS BIGINT) AS at, CAST([] AS BIGINT[]) AS ends, CAST([] AS DOUBLE[]) AS cs, CAST([] AS DOUBLE[]) AS es, CAST(NULL AS DOUBLE) AS rate
  FROM (SELECT DISTINCT feature FROM pre{tag}), (SELECT unnest([1, -1]) AS dir)
  UNION ALL
  SELECT w.feature, w.dir, s.j, list_append(w.ends, s.j), list_append(w.cs, s.cnt), list_append(w.es, s.ev), s.ev::DOUBLE / s.cnt
  FROM walk{tag} w JOIN seg{tag} s ON s.feature = w.feature AND s.i = w.at
  WHERE w.rate IS NULL OR w.dir * (s.ev::DOUBLE / s.cnt - w.rate) >= 0),
whole{tag} AS (SELECT DISTINCT w.feature, ends, cs, es, len(ends) AS k, t.evs AS te, t.rows - t.evs AS tn FROM walk{tag} w
  JOIN (SELECT DISTINCT feature, n, rows, evs FROM seq{tag}) t ON t.feature = w.feature AND t.n = w.at),
val{tag} AS (SELECT *, list_sum(list_transform(range(1, k + 1), lambda q:
    ((es[q] + {e}) / (te + {e} * k) - (cs[q] - es[q] + {e}) / (tn + {e} * k))
    * ln(((es[q] + {e}) / (te + {e} * k)) / ((cs[q] - es[q] + {e}) / (tn + {e} * k))))) AS iv FROM whole{tag}),
best{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(iv, 10) DESC, k, ends) AS r FROM val{tag}) WHERE r = 1),
each{tag} AS (SELECT feature, k, te, tn, unnest(range(0, k)) AS bin, ends FROM best{tag}),
bins{tag} AS (SELECT b.feature, CAST(b.bin AS INTEGER) AS bin, CAST(s.first AS INTEGER) AS first, CAST(s.last AS INTEGER) AS last, CAST(s.cnt AS BIGINT) AS count, CAST(s.ev AS BIGINT) AS events,
  ln(((s.ev + {e}) / (te + {e} * k)) / ((s.cnt - s.ev + {e}) / (tn + {e} * k))) AS woe,
  ((s.ev + {e}) / (te + {e} * k) - (s.cnt - s.ev + {e}) / (tn + {e} * k)) * ln(((s.ev + {e}) / (te + {e} * k)) / ((s.cnt - s.ev + {e}) / (tn + {e} * k))) AS iv
  FROM each{tag} b JOIN seg{tag} s ON s.feature = b.feature AND s.i = CASE WHEN b.bin = 0 THEN 0 ELSE b.ends[b.bin] END AND s.j = b.ends[b.bin + 1])""")
    return ",\n".join(parts)


def woe_of_rows(tag: str, key: str, missing: float) -> str:
    """(key, y, feature, woe): every row's weight of evidence, ``missing`` where it is in no bin."""
    return f"""SELECT p.{key}, p.y, p.feature, coalesce(b.woe, {missing!r}) AS woe
FROM placed{tag} p LEFT JOIN bins{tag} b ON b.feature = p.feature AND p.pre BETWEEN b.first AND b.last"""
