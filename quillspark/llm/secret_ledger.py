"""Secret scans over every historical version of a file, with DataFrame functions only.

Content is addressed by its SHA-256. A ledger remembers which (blob, rule, rule version)
have been scanned; a run runs each rule only over blobs whose pair with that rule's version
the ledger lacks, keeps findings by blob, and joins them back to every path and version that
holds the blob. So a copy costs nothing to scan, and a changed rule rescans with that rule
alone: the other rules' findings stay as they are known.

Nulls are read as empty text, which has no findings; equal contents share one scan and
get equal findings; texts are scanned whole; repeated rows each get their findings; an empty
table gives no rows, an empty ledger makes every pair unseen; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, whole_text


@dataclass(frozen=True)
class Rule:
    """kind; pattern, whose matches from the left that don't overlap count; group and
    least: a match whose group is shorter is dropped (after it has used up its text)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: Fixed formats: assignments of credentials, access keys and long hexadecimal strings; then the headers
#: of private keys and tokens with a public prefix.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,end:int>>"
FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Matches that are folded in one piece: a longer list of them is folded piece by piece.
PIECE = 512


def spans(text: Column, rule: Rule) -> Column:
    """Start and exclusive end, in code points, of the rule's matches, in order.

    The parts between matches and the matches come alternately, so their running
    lengths are the offsets. They are summed in pieces of PIECE: first each piece's
    start, then the matches within, so that the work doesn't grow with their square."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(kept, F.length).alias("held"))

    def width(x: Column) -> Column:
        return x["gap"] + F.coalesce(x["size"], F.lit(0))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        hit = F.array(F.struct(start.alias("start"), (state["at"] + width(x)).alias("end")))
        return F.struct((state["at"] + width(x)).alias("at"), F.when(x["held"] >= rule.least, F.concat(state["out"], hit)).otherwise(state["out"]).alias("out"))

    def within(piece: Column, base: Column) -> Column:
        return F.aggregate(piece, F.struct(base.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])

    def folded(all_steps: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / PIECE).cast("int")), lambda k: F.slice(all_steps, k * PIECE + 1, PIECE))
        long = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + width(x)))
        bases = F.aggregate(long, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(pieces, F.slice(bases, 1, F.size(pieces)), within))

    # One element that a lambda names, so that the matches are found once however often the fold reads them.
    once = F.element_at(F.transform(F.array(steps), folded), 1)
    return F.when(text.rlike(rule.pattern), once).otherwise(F.array().cast(SPAN))


def pair(rule: Rule) -> str:
    """How the ledger's pairs name a rule and its version."""
    return f"{rule.kind}@{rule.version}"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, missing and findings (start, rank of the kind, kind, end) of each blob's text, by
    start: each rule runs over the blobs whose missing pairs name it, and over no others."""

    def named(rank: int, kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    each = [F.when(F.array_contains("missing", pair(r)), F.transform(spans(F.col("text"), r), named(k, r.kind))).otherwise(F.array().cast(FINDING)) for k, r in enumerate(rules)]
    return blobs.select("blob", "missing", F.array_sort(F.concat(*each)).cast(FINDING).alias("findings"))


def address(versions: DataFrame) -> DataFrame:
    """Adds blob: the SHA-256 of the content."""
    return versions.withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))


def unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """One row (blob, text, missing) for each content that lacks a pair in the ledger (blob,
    kind, version); missing names the pairs. The ledger meets addresses; texts of blobs that
    lack nothing aren't shuffled together."""
    wanted = F.array(*[F.lit(pair(r)) for r in rules])
    if ledger is None:
        return versions.groupBy("blob").agg(F.any_value("text").alias("text")).select("blob", "text", wanted.alias("missing"))
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat("kind", F.lit("@"), F.col("version").cast("string"))).alias("done"))
    lacking = versions.select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("missing"))
    lacking = lacking.where(F.size("missing") > 0)
    return versions.join(lacking, "blob").groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("missing").alias("missing"))


def entries(fresh: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows (blob, kind, version): the pairs that a scan has covered."""
    rule_rows = F.array(*[F.struct(F.lit(pair(r)).alias("pair"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    covered = F.filter(rule_rows, lambda r: F.array_contains("missing", r["pair"]))
    return fresh.select("blob", F.explode(covered).alias("rule")).select("blob", "rule.kind", "rule.version")


def update(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The next (ledger, findings): what was known, and what the unseen pairs add.

    A pair that is scanned replaces what the ledger and known (blob, findings) held of
    that blob and kind; everything else of them stays."""
    fresh = scan(unseen(address(versions), rules, ledger), rules)
    if ledger is None or known is None:
        return entries(fresh, rules), fresh.select("blob", "findings")
    new = entries(fresh, rules)
    kinds = F.array(*[F.struct(F.lit(pair(r)).alias("pair"), F.lit(r.kind).alias("kind")) for r in rules])
    again = F.transform(F.filter(kinds, lambda k: F.array_contains("missing", k["pair"])), lambda k: k["kind"])
    added = fresh.select("blob", F.col("findings").alias("_new"), again.alias("_again"))
    none = F.array().cast(FINDING)
    kept = F.filter(F.coalesce("findings", none), lambda f: ~F.coalesce(F.array_contains("_again", f["kind"]), F.lit(False)))
    merged = known.join(added, "blob", "full").select("blob", F.array_sort(F.concat(kept, F.coalesce("_new", none))).alias("findings"))
    return ledger.join(new, ["blob", "kind"], "left_anti").select("blob", "kind", "version").unionByName(new), merged


def by_path(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """Every path of versions (path, blob and whatever else) with its findings, none as an empty list.

    Blobs without findings don't take part in the join, so what is shuffled by blob
    on that side is small; hot blobs are split by adaptive execution."""
    some = findings.where(F.size("findings") > 0)
    return versions.join(some, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))


def find_secrets(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, blob and findings of each row of docs, by one first run of the ledger."""
    versions = docs.select(*keys, whole_text().alias("text"))
    _, findings = update(versions, rules=rules)
    return by_path(address(versions).drop("text"), findings)


def redact(text: Column, findings: Column) -> Column:
    """The text with every finding (by start, overlaps merged) replaced by [kind]."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    def last(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))

    return F.when(F.size(findings) > 0, F.aggregate(findings, state, step, last)).otherwise(text)


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = F.col("findings")

    def of(*kinds: str) -> Column:
        return F.filter(found, lambda f: f["kind"].isin(*kinds))

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(of(*[r.kind for r in BASE])), 256).alias("base_sha256"),
        joined(found).alias("spans"),
    )


_FOUND = "STRUCT(s BIGINT, r INTEGER, k VARCHAR, e BIGINT)[]"


def _duck(rule: Rule, rank: int) -> str:
    """A list of (start, rank, kind, end) of the rule's matches in DuckDB."""
    p = rule.pattern.replace("'", "''")
    part = f"string_split_regex(t, '{p}')"
    hit = f"regexp_extract_all(t, '{p}')"
    held = f"regexp_extract_all(t, '{p}', {rule.group})"
    return f"""CASE WHEN regexp_matches(t, '{p}') THEN list_transform(list_filter(range(1, len({hit}) + 1), lambda i: length({held}[i]) >= {rule.least}), lambda i: {{
      's': CAST(list_sum(list_transform({part}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({hit}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'r': {rank}, 'k': '{rule.kind}',
      'e': CAST(list_sum(list_transform({part}[1:i], lambda x: length(x))) + list_sum(list_transform({hit}[1:i], lambda x: length(x))) AS BIGINT)}})::{_FOUND} ELSE []::{_FOUND} END"""


_NAMED = "list_transform({}, lambda z: z.k || ':' || z.s || ':' || z.e)"
SQL = {
    "op9_secret_ledger": f"""
WITH scanned AS (
  SELECT doc_id, list_sort(list_concat({", ".join(_duck(r, k) for k, r in enumerate(RULES))})) AS f
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), base AS (SELECT doc_id, f, list_filter(f, lambda x: x.r < {len(BASE)}) AS b FROM scanned)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(b, lambda x: x.r = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))},
  sha256(array_to_string({_NAMED.format("b")}, ',')) AS base_sha256, array_to_string({_NAMED.format("f")}, ',') AS spans
FROM base"""
}
QUERIES = {"op9_secret_ledger": op9_secret_ledger}
