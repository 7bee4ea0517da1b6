"""Secret scans that link the parts of a credential.

Base findings are assignments, access identifiers and hexadecimal strings. Two weak kinds are looked for only in texts
with an access identifier: ``part`` (a lone string of 40 base-64 characters) and ``endpoint`` (a web or bucket
address). A part is reported when an access identifier begins within ``SCOPE`` code points of it; an endpoint when both
an access identifier and some secret (a part, an assignment or a hexadecimal string) do. The interval join works on
bins as wide as the scope: per text and bin only the first and last place of each role is kept, and a candidate meets
its own bin and the two beside it, so no pairs of findings are made.

Nulls count as empty; such texts have no finding. Repeated rows each get a row; a null ``doc_id`` stays null. Texts of
any length are scanned whole; each finding is a row of its own until the last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.llm.common import stored, texts

SCOPE = 400
# The words and forms of the base findings.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 6
# Runs of these characters are maximal, so a least length in the pattern is the same as a test afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# An equals sign before a part assigns it; one behind it is padding of a longer value.
PART = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?:https?|s3)://[^\s"'<>]+"""

KINDS = ("assign", "access", "hex", "part", "endpoint")
BASE = 3
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "part": "secret", "endpoint": "endpoint"}


def _found(pattern: str, wanted: Column) -> Column:
    """What stands before, between and behind the matches; null where none can be."""
    return F.when(wanted, F.split("text", pattern, -1))


def _matches(kind: str, pattern: str) -> Column:
    """The lengths of each match and of the gap before it, in code points, and whether the match holds."""
    gaps, matches = F.col(f"{kind}_gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    holds = (
        lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= ASSIGN_LENGTH
    ) if kind == "assign" else (lambda m: F.lit(True))
    spans = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(gaps) - 1), matches,
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("size"), holds(match).alias("holds")
        ),
    )
    return F.when(F.size(gaps) > 1, spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` a number of its own and for each kind the list of matches with gaps; stored once."""
    lowered = F.lower("text")
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, PART, ENDPOINT)))
    assigned = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(word)) for word in ASSIGN_WORDS))
    has_access = F.contains(F.col("text"), F.lit("AKIA"))
    wanted = {"assign": assigned, "access": has_access, "hex": F.lit(True), "part": has_access, "endpoint": has_access}
    rows = texts(docs).withColumns({f"{k}_gaps": _found(patterns[k], wanted[k]) for k in KINDS})
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", *(_matches(k, patterns[k]).alias(k) for k in KINDS)
        ),
        "secret-matches",
    )


def spans(matches: DataFrame) -> DataFrame:
    """One row per match that holds: ``row``, ``kind`` (its place in ``KINDS``), ``begin`` and ``end``."""
    listed = reduce(
        DataFrame.unionAll,
        (
            matches.filter(F.col(name).isNotNull()).select(
                "row", F.lit(kind).alias("kind"), F.posexplode(name).alias("place", "match")
            )
            for kind, name in enumerate(KINDS)
        ),
    )
    before = W.partitionBy("row", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return (
        listed.withColumn("end", F.sum(F.col("match.gap") + F.col("match.size")).over(before))
        .filter("match.holds")
        .select("row", "kind", (F.col("end") - F.col("match.size")).alias("begin"), "end")
    )


def _near(candidates: DataFrame, parts: DataFrame, role: str) -> DataFrame:
    """Candidates that have a part of the role within the scope."""
    kinds = [n for n, kind in enumerate(KINDS) if ROLES[kind] == role]
    bins = (
        parts.filter(F.col("kind").isin(kinds))
        .groupBy(F.col("row").alias("part_row"), F.floor(F.col("begin") / SCOPE).alias("part_bin"))
        .agg(F.min("begin").alias("first"), F.max("begin").alias("last"))
    )
    probes = candidates.withColumn("bin", F.floor(F.col("begin") / SCOPE)).withColumn(
        "near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))
    )
    reached = (F.col("last") >= F.col("begin") - SCOPE) & (F.col("first") <= F.col("begin") + SCOPE)
    return (
        probes.join(bins, (F.col("row") == F.col("part_row")) & (F.col("near") == F.col("part_bin")) & reached)
        .select("row", "kind", "begin", "end")
        .distinct()
    )


def linked(found: DataFrame) -> DataFrame:
    """Base spans, and the weak candidates whose complementary parts are near."""
    part, endpoint = KINDS.index("part"), KINDS.index("endpoint")
    base = found.filter(F.col("kind") < BASE)
    parts = _near(found.filter(F.col("kind") == part), base, "id")
    strong = base.unionAll(parts)
    ends = _near(_near(found.filter(F.col("kind") == endpoint), base, "id"), strong, "secret")
    return strong.unionAll(ends)


def _joined(items: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(items, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string")
        )), ",",
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("items", lambda s: s["kind"] == kind))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base findings, the digest of their list, and the list with linked candidates."""
    matches = scanned(docs)
    found = stored(spans(matches), "secret-spans")
    lists = linked(found).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("begin", "kind", "end"))).alias("items")
    )
    rows = matches.select("row", "doc_id").join(lists, "row", "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<begin:bigint,kind:int,end:bigint>>"))
    )
    counts = [_count(kind).cast("long").alias(f"n_{KINDS[kind]}") for kind in range(BASE)]
    base = F.filter("items", lambda s: s["kind"] < BASE)
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("items")).alias("spans"))
