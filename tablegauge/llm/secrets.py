"""Secrets in texts, told apart from examples by who else has them.

Patterns find assignments, access keys and hex strings; a further pattern finds long tokens
of letters and digits that no pattern names. Every candidate is hashed, and the corpus is
asked how many owners, and how many repositories of all owners, hold the same value. What many
owners hold is a copied example, and so is what one owner holds in many repositories. What
few owners hold in few repositories looks live: such a token becomes a span of its own, and
every span says how many hold its value.

All of it is column expressions. Counting goes from (value, owner, repository) to (value,
owner) to value, each step with partial aggregation, so a value in a third of all documents
stays a few rows per task; verdicts return by a merge join whose hot side can be split.

Defined results: a null text is empty; a null owner or repository counts as one of its own;
an empty table gives an empty result; repeated rows are scanned as often as they occur, and are
one repository; exactly as many owners or repositories as allowed still look live; long texts
are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.text import text_of
from tablegauge.llm.work import Scratch

# The patterns by kind, with the group that holds the value and its least length.
PATTERNS = (
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
TOKEN = ("token", "[A-Za-z0-9+_=-]{20,}", 0, 20)
MAX_OWNERS = 2
MAX_REPOSITORIES = 10
CHUNK = 256


def _running(lengths: Column) -> Column:
    """Running sums of an array, in chunks so that long arrays don't cost their square."""
    chunks = F.when(
        F.size(lengths) > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
            lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)),
        ),
    ).otherwise(F.array().cast("array<array<bigint>>"))

    def sums(values: Column) -> Column:
        return F.aggregate(
            values,
            F.array().cast("array<bigint>"),
            lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + v)),
        )

    def combined(inner: Column) -> Column:
        ends = sums(F.transform(inner, lambda a: F.element_at(a, -1)))
        return F.flatten(
            F.transform(inner, lambda a, i: F.transform(a, lambda v: v + F.when(i > 0, ends[i - 1]).otherwise(0)))
        )

    return _let(F.transform(chunks, sums), combined)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPAN = "array<struct<start: bigint, kind_no: int, kind: string, end: bigint, value: string>>"


def _spans(
    kind_no: int, kind: str, pattern: str, group: int, least: int, text: Column, mixed: bool = False
) -> Column:
    """All matches of one kind in order, with places in code points and hashed values.

    ``mixed``: only values with a letter and a digit.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)

    def located(m: Column) -> Column:
        lengths = F.transform(m["whole"], lambda w, i: (F.length(w) + F.length(m["gaps"][i])).cast("long"))

        def spans(ends: Column) -> Column:
            return F.transform(
                m["whole"],
                lambda w, i: F.struct(
                    (ends[i] - F.length(w)).alias("start"),
                    F.lit(kind_no).alias("kind_no"),
                    F.lit(kind).alias("kind"),
                    ends[i].alias("end"),
                    m["values"][i].alias("value"),
                ),
            )

        return _let(_running(lengths), spans)

    found = _let(F.struct(whole.alias("whole"), values.alias("values"), gaps.alias("gaps")), located)
    def fits(span: Column) -> Column:
        long = F.length(span["value"]) >= least
        return long & span["value"].rlike("[0-9]") & span["value"].rlike("[A-Za-z]") if mixed else long

    kept = F.filter(found, fits)
    hashed = F.transform(kept, lambda s: s.withField("value", F.sha2(s["value"], 256))).cast(SPAN)
    return F.when(text.rlike(pattern), hashed).otherwise(F.array().cast(SPAN))


def _token_spans(text: Column, base: Column) -> Column:
    """Tokens with letters and digits that touch none of the base spans."""
    spans = _spans(len(PATTERNS), *TOKEN, text, mixed=True)
    return F.filter(
        spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """``row``, ``doc_id``, ``owner``, ``repository``, ``base`` and ``tokens`` (arrays of spans)."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        text_of().alias("text"),
    )
    base = F.concat(*[_spans(i, *p, text) for i, p in enumerate(PATTERNS)])
    rows = rows.withColumn("base", F.array_sort(base))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "owner",
        "repository",
        "base",
        _token_spans(text, F.col("base")).alias("tokens"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """``value``, ``owners``, ``repositories`` from rows of ``value``, ``owner``, ``repository``."""
    return (
        found.groupBy("value", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )


def secret_spans(
    docs: DataFrame,
    *,
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` (spans of the patterns) and ``spans`` (these
    and live-looking tokens), in order; every span of ``spans`` has ``owners``,
    ``repositories`` and ``live``.

    ``owner`` and ``repository``: columns of ``docs``; by default ``source`` and ``doc_id``.
    """
    scratch = Scratch(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    table = scratch.keep(candidates(docs, owner, F.col("doc_id") if repository is None else repository), "found")
    each = table.select("row", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("s"))
    each = each.select("row", "owner", "repository", "s", "s.value")
    counts = scratch.keep(ownership(each), "ownership")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    named = F.col("s.kind") != TOKEN[0]
    judged = (
        each.join(counts.hint("merge"), "value")
        .where(named | live)
        .select(
            "row",
            F.struct("s.start", "s.kind_no", "s.kind", "s.end", "owners", "repositories", live.alias("live")).alias("s"),
        )
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )
    none = F.array().cast(judged.schema["spans"].dataType)
    return table.join(judged.hint("merge"), "row", "left").select(
        "doc_id", "base", F.coalesce("spans", none).alias("spans")
    )


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame, **parameters) -> DataFrame:
    """Counts, the digest of the base spans, all spans as text, and by how many owners and
    repositories the most widely held of their values is held (0 without spans)."""
    found = secret_spans(docs, **parameters)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    def most(holders: str) -> Column:
        return F.coalesce(F.array_max(F.transform("spans", lambda s: s[holders])), F.lit(0))

    return found.select(
        "doc_id",
        *[count(p[0]).alias(f"n_{p[0]}") for p in PATTERNS],
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        most("owners").alias("most_owners"),
        most("repositories").alias("most_repositories"),
    )
