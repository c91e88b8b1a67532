"""URL rules by Bloom filter cascades: exact membership of keys without joins.

A rule is a host with a path prefix. The keys that a url can match are each suffix of its host at a dot, joined
with each beginning of its path that is as long as some rule's path. The distinct keys of all urls are the
complete universe of keys that are ever asked for. Level 1 of a cascade is a Bloom filter of the listed keys;
level 2 one of the unlisted keys of the universe that level 1 takes for listed; level 3 one of the listed keys
that level 2 contains, and so on until no key is wrong. A key's answer is then exact for the whole universe:
it is listed if the first level that lacks it is even (or none lacks it and the number of levels is odd).

Size: with r listed and s other keys, the first level's error rate is r / (s * sqrt(2)) and that of the others
1/2, so all levels together take about r * log2(s / r) bits: they grow with the list and hardly with the corpus.
A list of any length is cut by a hash of the key in parts of about PART_KEYS keys, with a cascade each over the part's keys of
the universe. A part is what is sent to the executors at once; further parts are further passes over the keys of the urls.

A null url, or one without "://", has empty host and path and fits no rule. The host ends at the first of / ? #,
the path at the first of ? #. Repeated urls are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize

#: Listed keys of a part, on average, and cascades that are asked in one pass over the urls.
PART_KEYS, PASS = 50_000, 2
#: Host, path prefix and verdict of each rule.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise(F.lit(""))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule could have, longest first: suffixes of the host with beginnings of the path."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    )
    starts = F.array_distinct(F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda x: x.isNotNull()))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.array_sort(both, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key in one level."""
    return [F.pmod(F.xxhash64(F.lit(level * 1000 + i), key), F.lit(bits)) for i in range(hashes)]


class Cascade:
    """Levels of (bits, hashes, set bit numbers in 64-bit words)."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    def _in_level(self, key: Column, k: int) -> Column:
        bits, hashes, words = self.levels[k]
        table = F.lit(b"".join((w & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") for w in words)).cast("binary")
        found = F.lit(True)
        for place in _places(key, k, bits, hashes):
            byte = F.conv(F.hex(F.substring(table, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)
        return found

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self._in_level(key, k), F.lit(k % 2 == 1)).otherwise(answer)
        return answer

    def bits(self) -> int:
        return sum(x[0] for x in self.levels)


def _fill(keys: DataFrame, level: int, bits: int, hashes: int) -> list[int]:
    """The level's words with the bits of all keys: OR-ed on the executors, at most bits / 64 rows come back."""
    places = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("p"))
    word = F.shiftrightunsigned("p", 6).alias("w")
    rows = places.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).collect()
    words = [0] * ((bits + 63) // 64)
    for r in rows:
        words[r.w] = r.v
    return words


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for each key of universe (column key, distinct); listed has the keys to be found, few enough to be broadcast."""
    r = listed.count()
    inside = universe.join(F.broadcast(listed), "key", "left_semi")
    outside = universe.join(F.broadcast(listed), "key", "left_anti")
    levels: list[tuple[int, int, list[int]]] = []
    made: list[DataFrame] = []
    members, others = listed, outside
    n, s = max(r, 1), outside.count()
    while True:
        k = len(levels)
        rate = min(0.5, n / (max(s, 1) * math.sqrt(2))) if k == 0 else 0.5
        bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        hashes = max(1, round(bits / n * math.log(2))) if n * 8 < bits else max(1, round(-math.log2(rate)))
        hashes = min(hashes, 16)
        levels.append((bits, hashes, _fill(members, k, bits, hashes)))
        one = Cascade(levels)
        wrong = others.where(one._in_level(F.col("key"), k))
        wrong = materialize(wrong.select("key"), "cascade")
        n = wrong.count()
        made.append(wrong)
        if n == 0:
            discard(*made)
            return one
        members, others = wrong, inside if k == 0 else members


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def _listed_in(k: int, parts: int, cascade: Cascade):
    return lambda key: ((part_of(key, parts) == k) if parts > 1 else F.lit(True)) & cascade.contains(key)


def build_parts(listed: DataFrame, universe: DataFrame) -> list[tuple[int, int, Cascade]]:
    """(part, number of parts, cascade of that part's keys) for a list of any length."""
    parts = max(1, -(-listed.count() // PART_KEYS))
    if parts == 1:
        return [(0, 1, build_cascade(listed, universe))]
    mine = lambda df, k: df.where(part_of(F.col("key"), parts) == k)
    return [(k, parts, build_cascade(mine(listed, k), mine(universe, k))) for k in range(parts)]


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict (the rule's, else otherwise) of each row.

    rules are triples (host, path, verdict allow or block) or a DataFrame of these columns, as many as one likes. A url that
    no rule fits has no listed key; the method's verdict for it is that of unlisted keys, otherwise. A rule that is both
    allowed and blocked blocks.
    """
    spark = pages.sparkSession
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    lengths = sorted(r[0] for r in given.select(F.length("path")).distinct().collect())
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = materialize(rows.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct().select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "universe")
    asked = []
    for verdict in ("block", "allow"):
        listed = given.where(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key")).distinct()
        asked += [(verdict, *part) for part in build_parts(listed, universe)]
    discard(universe)
    longer = lambda a, b: F.when(a.isNull() | (F.length(b["rule"]) > F.length(a["rule"])), b).otherwise(a)
    found = rows.withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    for at in range(0, len(asked), PASS):
        best = F.col("best")
        for verdict, k, parts, cascade in asked[at : at + PASS]:
            hit = F.get(F.filter(keys_of(F.col("host"), F.col("path"), lengths), _listed_in(k, parts, cascade)), F.lit(0))
            best = F.when(hit.isNull(), best).otherwise(longer(best, F.struct(hit.alias("rule"), F.lit(verdict).alias("verdict"))))
        before, found = found, found.withColumn("best", best)
        if at + PASS < len(asked):
            found = materialize(found, "pass")
            discard(before) if at else None
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = """
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS n
        FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT hp.page_id, hp.host, hp.path, fit.rule, coalesce(fit.v, 'allow') AS verdict FROM hp LEFT JOIN fit ON hp.page_id = fit.page_id AND fit.n = 1
"""
