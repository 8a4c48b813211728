"""URL filters: a Bloom filter cascade, in DataFrame operations only.

A rule is a (host, path, verdict); it fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's. The keys of a URL are its host suffixes joined with its path prefixes, of the
label counts and path lengths that rules have. Level 0 of a cascade is a Bloom filter of the listed keys;
level 1 holds those keys of the corpus's whole key universe that level 0 passes wrongly; level 2 the listed
keys that level 1 passes wrongly, and so on until nothing is wrong. A key is listed if the first level it
doesn't pass has an odd number (or, when it passes all, if there's an odd number of levels): exact for
every key in the universe, with no join in the filter.

Bits are set by an aggregation on the executors; a level travels as 64-bit words, about
1.44 * rules * log2(keys / rules) bits in all, so its size follows the rule list, not the corpus.

Defined cases: null URLs and URLs without ``://`` have empty host and path, no keys and the default verdict;
an empty rule list gives the default verdict everywhere; repeated rules count once, and a
key listed with both verdicts is blocked; repeated rows are each judged; other columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, materialise

#: Rule list of the registered query: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Candidate keys of a URL, longest first: one for each (label count, path length) it is long enough for."""
    labels = F.split(host, r"\.", -1)
    made = [
        F.when(
            (F.size(labels) >= k) & (F.length(path) >= n) & (host != ""),
            F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)),
        )
        for k, n in shapes
    ]
    found = F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.array().cast("array<string>")
    return F.array_sort(found, lambda a, b: F.length(b) - F.length(a))


#: Bits of the largest level (32 MB): some ten million rules.
MAX_BITS = 1 << 28


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + k)), F.lit(bits)) for k in range(hashes)]


class Level:
    """One Bloom filter: ``bits`` positions in 64-bit words, ``hashes`` probes."""

    def __init__(self, keys: DataFrame, level: int, expected: int, rate: float):
        """keys: rows with a column ``key``; words are or-ed together on the executors."""
        self.level = level
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, 64 * math.ceil(1.4427 * max(expected, 1) * -math.log2(rate) / 64))
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, self.bits, self.hashes))).alias("b"))
        if self.bits > MAX_BITS:
            raise ValueError(f"a level of {self.bits} bits for {expected} keys; the filter is made for at most {MAX_BITS}")
        words = at.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()
        held = dict((r.w, r.v) for r in words)  # at most bits / 64 words
        self.table = F.lit(b"".join(held.get(i, 0).to_bytes(8, "little", signed=True) for i in range(self.bits // 64)))

    def passes(self, key: Column) -> Column:
        # one byte of the table, which is one literal of the plan, however often it is probed
        byte = lambda b: F.conv(F.hex(F.substring(self.table, F.floor(b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests = [F.getbit(byte(b), (b % 8).cast("int")) == 1 for b in _positions(key, self.level, self.bits, self.hashes)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """Exact membership of the listed keys among a universe of keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int, max_levels: int = 40):
        """listed, universe: rows with a column ``key``; the universe is scanned once."""
        self.levels: list[Level] = []
        if not n_listed:
            return
        rate = min(0.5, math.sqrt(0.5) * n_listed / max(n_universe, 1))
        wrong, right = universe, listed
        for k in range(max_levels):
            level = Level(right, k, n_listed if k == 0 else count, rate if k == 0 else 0.5)
            self.levels.append(level)
            found = wrong.where(level.passes(F.col("key"))).distinct()
            if k == 0:
                found = found.join(listed, "key", "left_anti")
            found = materialise(found)
            count = found.count()
            if not count:
                return
            wrong, right = right, found
        raise RuntimeError("the cascade doesn't end: two keys have the same hashes at every level")

    def has(self, key: Column) -> Column:
        """True for listed keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(~self.levels[k].passes(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; the longest fitting rule decides."""
    listed = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .groupBy(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.", -1)).alias("k"), F.length("path").alias("n"))
        .agg(F.max("verdict").alias("verdict"))
    )
    listed = materialise(listed)
    shapes = sorted((r.k, r.n) for r in listed.select("k", "n").distinct().collect())
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = pages.withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("keys").alias("key"))
    n_universe = max(1, pages.count() * len(shapes))
    cascades = {v: Cascade(part := listed.where(F.col("verdict") == v).select("key"), universe, part.count(), n_universe) for v in ("allow", "block")}
    fits = {v: F.filter("keys", c.has) for v, c in cascades.items()}
    first = {v: F.get(f, F.lit(0)) for v, f in fits.items()}
    longer = lambda v: F.coalesce(F.length(f"first_{v}"), F.lit(-1))
    judged = keyed.select("page_id", "host", "path", *(c.alias(f"first_{v}") for v, c in first.items()))
    blocked = longer("block") > longer("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(blocked, F.col("first_block")).otherwise(F.col("first_allow")).alias("rule"),
        F.when(blocked, "block").when(F.col("first_allow").isNotNull(), "allow").otherwise(default).alias("verdict"),
    )


ORACLE = r"""
with rules(host, path, verdict) as (values
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
parts as (
  select page_id,
    translate(case when contains(coalesce(url, ''), '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when contains(coalesce(url, ''), '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages)
select p.page_id, p.host, p.path,
  (select r.host || r.path from rules r
    where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    order by length(r.host || r.path) desc limit 1) as rule,
  coalesce((select r.verdict from rules r
    where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    order by length(r.host || r.path) desc limit 1), 'allow') as verdict
from parts p
"""
