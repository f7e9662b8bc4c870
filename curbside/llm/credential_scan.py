"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by fixed patterns. ``opaque`` candidates are long runs of key characters
with a digit, a small and a capital letter, outside base spans. The hash of every candidate
value is counted over the corpus: in how many repositories (documents of an owner) and by how
many owners (sources) it appears. Values of more than ``max_owners`` owners, or of several
owners and more than ``max_repositories`` repositories, are widely copied examples; others are
specific to their owner, in however many of its repositories, and look live. Live opaque runs
are reported as additional spans. Base spans are always reported.

A match starts after all texts and matches before it, so its place is a running sum over the
lengths of both. Sums, overlaps and joined spans are windows over the matches of a document:
work is linear in a text and its matches (but for sorting), and no text is moved. Texts without
a match stop at one pattern test.

Counting is by (hash, owner, document), then (hash, owner), then hash, combined on the map side;
the counts of values in several repositories join back salted, since an example may be in a third
of all documents.

Defined cases: a null text is empty; a null owner is an owner of its own; documents of an owner
with one id, or without id, are one repository; repeated rows are answered each by itself; a
very long text is one row of one task; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.llm.common import written

#: Patterns of the base kinds, in the order in which kinds are listed.
PATTERNS = {
    "assign": (
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]{24,})",
    "opaque": "([A-Za-z0-9+/_-]{24,})",
}
KINDS = list(PATTERNS)
VALUE_GROUP = {"assign": 2, "access": 1, "hex": 1, "opaque": 1}
LEAST = {"assign": 6, "access": 20, "hex": 24, "opaque": 24}

MAX_OWNERS = 2
MAX_REPOSITORIES = 20
SALTS = 16
MARK = "[SECRET]"
#: Code points of the chunks in which a text is redacted.
CHUNK = 1024

OPAQUE = KINDS.index("opaque")
FOUND = "array<struct<kind:int,gap:int,size:int,good:boolean,hash:long>>"
SPANS = (
    "array<struct<start:int,kind:int,end:int,hash:long,n_owners:long,n_repositories:long,"
    "copied:boolean,covered:int>>"
)


def none(schema: str) -> Column:
    return F.array().cast(schema)


def matches(text: Column, kind: str) -> Column:
    """Matches of a kind in order: length of the text before each since the last one, its own
    length, whether it counts, and the hash of its value."""
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(VALUE_GROUP[kind]))
    gaps = F.split(text, PATTERNS[kind], -1)

    def measured(x: Column) -> Column:
        good = F.coalesce(F.char_length(x["value"]), F.lit(0)) >= LEAST[kind]
        if kind == "opaque":
            for letters in ("[0-9]", "[a-z]", "[A-Z]"):
                good = good & x["value"].rlike(letters)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.char_length(x["gap"]).alias("gap"),
            F.coalesce(F.char_length(x["match"]), F.lit(0)).alias("size"),
            good.alias("good"),
            F.xxhash64(x["value"]).alias("hash"),
        )

    places = F.arrays_zip(gaps.alias("gap"), whole.alias("match"), values.alias("value"))
    return F.when(text.rlike(PATTERNS[kind]), F.transform(places, measured).cast(FOUND)).otherwise(none(FOUND))


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """All documents without their texts (``row``, ``doc_id``, ``text_hash``), and one row for
    each base span and each opaque span that meets no base span."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    heads = written(
        source.select(
            "row", "doc_id", "owner",
            F.xxhash64("text").alias("text_hash"),
            F.concat(*[matches(F.col("text"), k) for k in KINDS]).alias("found"),
        ),
        "credentials",
    )
    of_kind = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    by_start = W.partitionBy("row").orderBy("start")
    from_end = W.partitionBy("row").orderBy(F.desc("start"))
    is_base = F.col("kind") != OPAQUE
    spans = (
        heads.filter(F.size("found") > 0)
        .repartition("row")
        .select("row", "owner", "doc_id", F.posexplode("found").alias("pos", "m"))
        .select("row", "owner", "doc_id", "pos", "m.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(of_kind).cast("int"))
        .withColumn("start", F.col("end") - F.col("size"))
        .filter("good")
        .withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(by_start))
        .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(from_end))
    )
    meets = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("next") < F.col("end"), F.lit(False)
    )
    spans = spans.filter(is_base | ~meets).select("row", "owner", "doc_id", "start", "kind", "end", "hash")
    return heads.drop("found"), written(spans, "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate value."""
    return (
        spans.select("hash", "owner", "doc_id")
        .distinct()
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("hash")
        .agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    )


def reported(spans: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """Spans with the counts of their values, without opaque ones that are widely copied."""
    shared = (
        ownership(spans)
        .filter("n_repositories > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    several = (F.col("n_owners") > 1) & (F.col("n_repositories") > max_repositories)
    return (
        salted.join(shared, ["hash", "salt"], "left")
        .fillna(1, ["n_owners", "n_repositories"])
        .withColumn("copied", (F.col("n_owners") > max_owners) | several)
        .filter((F.col("kind") != OPAQUE) | ~F.col("copied"))
    )


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),  # noqa: E501
        ),
        ",",
    )


def credential_scan(
    docs: DataFrame,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
) -> DataFrame:
    """Spans of each document as arrays, by start: ``base`` and ``added``. A span holds its place,
    the counts of its value, whether that is ``copied``, and how far earlier spans reach
    (``covered``); ``text_hash`` tells rows with one id apart."""
    heads, spans = candidates(docs, doc_id, text, owner)
    earlier = W.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1)
    of_row = (
        reported(spans, max_owners, max_repositories)
        .withColumn("covered", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "start", "kind", "end", "hash", "n_owners", "n_repositories", "copied", "covered"
                    )
                )
            ).alias("spans")
        )
    )
    return (
        heads.join(of_row, "row", "left")
        .withColumn("spans", F.coalesce(F.col("spans").cast(SPANS), none(SPANS)))
        .select(
            "doc_id", "text_hash",
            F.filter("spans", lambda s: s["kind"] != OPAQUE).alias("base"),
            F.filter("spans", lambda s: s["kind"] == OPAQUE).alias("added"),
        )
    )


def scan_report(scan: DataFrame) -> DataFrame:
    """Counts, digests and span lists of a scan, one row per document; ``most_owners`` and
    ``most_repositories`` are those of its most widely held value (0 without spans)."""

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    def most(count: str) -> Column:
        return F.coalesce(F.array_max(F.transform(both, lambda s: s[count])), F.lit(0)).alias(f"most_{count[2:]}")

    both = F.concat("base", "added")
    return scan.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(both)).alias("spans"),
        F.size(F.filter(both, lambda s: ~s["copied"])).cast("long").alias("n_live"),
        F.size(F.filter(both, lambda s: s["copied"])).cast("long").alias("n_copied"),
        most("n_owners"),
        most("n_repositories"),
    )


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Text from ``start`` to ``end``, from its chunks: only the chunks at both ends are searched."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    between = F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0)))
    return F.when(
        first == last, F.coalesce(F.substring(F.get(chunks, first), start % CHUNK + 1, end - start), F.lit(""))
    ).otherwise(
        F.concat(
            F.substring(F.get(chunks, first), start % CHUNK + 1, F.lit(CHUNK)),
            F.array_join(between, ""),
            F.coalesce(F.substring(F.get(chunks, last), F.lit(1), end % CHUNK), F.lit("")),
        )
    )


def redacted(
    docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """All documents with their columns; every reported span of ``text`` is replaced by a mark
    (spans that overlap by one), and ``n_chars``, if there, counts the new text."""
    scan = credential_scan(docs, max_owners, max_repositories)
    spans = (
        scan.select(
            F.col("doc_id").alias("__id"),
            F.col("text_hash").alias("__hash"),
            F.array_sort(F.concat("base", "added")).alias("__spans"),
        )
        .filter(F.size("__spans") > 0)
        .dropDuplicates(["__id", "__hash"])
    )
    joined = docs.join(
        spans.hint("merge"),  # grows with the documents
        docs.doc_id.cast("long").eqNullSafe(F.col("__id"))
        & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == F.col("__hash")),
        "left",
    )
    changed = F.col("__spans").isNotNull()
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    joined = joined.withColumn("__chunks", F.when(changed, pieces))
    chunks = F.col("__chunks")

    def kept_before(s: Column) -> Column:
        gap = F.concat(cut(chunks, s["covered"], s["start"]), F.lit(MARK))
        return F.when(s["start"] >= s["covered"], gap).otherwise(F.lit(""))

    last = F.array_max(F.transform("__spans", lambda s: s["end"]))
    rest = cut(chunks, last, F.char_length("text"))
    new = F.concat(F.array_join(F.transform("__spans", kept_before), ""), rest)
    out = joined.withColumn("__new", F.when(changed, new).otherwise(F.col("text")))
    length = F.char_length("__new")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__new").alias(c)
        if c == "n_chars":
            return F.when(changed, length.cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return out.select(*[column(c) for c in docs.columns])
