"""Scans over tables of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.functions import recognisers as pii
from promptledger.functions.findings import literal, running_totals, secret_findings, unicode_aware
from promptledger.functions.rules import CATALOGUE, SecretRule
from promptledger.session import lookup_join, settle

#: Up to so many names stand in the plan as a hash set; the results are the same either way.
INLINE_NAMES = 5_000
_WORD = literal(unicode_aware(r"\w+"))
_WHOLE = literal(unicode_aware(r"(?s)\w(?:.*\w)?"))
_SPACE = literal(unicode_aware(r"\s+"))


def scan_secrets(
    df: DataFrame, text: str = "content", rules: Sequence[SecretRule] = CATALOGUE
) -> DataFrame:
    """Add ``findings``: every catalogue match, without the raw value."""
    return settle(df.withColumn("findings", secret_findings(text, rules)), "findings")


def scan_pii(
    df: DataFrame,
    text: str = "content",
    entities: Sequence[str] | None = None,
    threshold: float = pii.DEFAULT_THRESHOLD,
    names: DataFrame | None = None,
    recognisers: Sequence[pii.Recogniser] | None = None,
    any_space: bool = True,
) -> DataFrame:
    """Add ``findings``: personal data above the score threshold.

    ``any_space``: a listed name is also found with other white space between its words,
    as it is when blocking and redacting.
    """
    hit = with_pii_hits(df, text, "_hits", entities, threshold, names, recognisers, any_space)
    found = hit.withColumn("findings", pii.hits_to_findings("_hits")).drop("_hits")
    return settle(found, "findings")


def with_pii_hits(
    df: DataFrame,
    text: str,
    out: str,
    entities: Sequence[str] | None = None,
    threshold: float = pii.DEFAULT_THRESHOLD,
    names: DataFrame | None = None,
    recognisers: Sequence[pii.Recogniser] | None = None,
    any_space: bool = True,
) -> DataFrame:
    """Add the transient hits array (it holds raw matches).

    ``any_space``: any run of white space in a name is like any other.
    """
    pii.check_threshold(threshold)
    chosen = pii.choose(entities) if recognisers is None else tuple(recognisers)
    if names is None or not (entities is None or pii.PERSON in entities):
        return df.withColumn(out, pii.pii_hits(text, chosen, threshold))
    listed = _name_table(names, any_space)
    sizes = [r["n"] for r in listed.select("n").distinct().orderBy("n").collect()]
    short = listed.limit(INLINE_NAMES + 1).collect()
    if len(short) <= INLINE_NAMES:
        found = _names_inline(df, text, short, sizes, any_space)
    else:
        # Hits depend on the text alone, so that is what they are joined back on.
        keyed = df.withColumn("_text", _digest(text))
        # Hits are narrow, so they are what a task holds; the rows stream past them, unsorted.
        hits = name_hits(df, text, listed, sizes, any_space).hint("shuffle_hash")
        found = keyed.join(hits, "_text", "left").drop("_text")
    return found.withColumn(
        out, pii.pii_hits(text, chosen, threshold, more="_names")
    ).drop("_names")


def _compared(name: str, any_space: bool) -> str:
    """SQL for the form in which a name is compared."""
    return f"regexp_replace({name}, {_SPACE}, ' ')" if any_space else name


def _name_table(names: DataFrame, any_space: bool) -> DataFrame:
    """Distinct (name, n words, first word): from the name's first word to its last."""
    whole = names.select(F.expr(f"regexp_extract(name, {_WHOLE}, 0)").alias("name")).where("name <> ''")
    whole = whole.select(F.expr(_compared("name", any_space)).alias("name"))
    words = whole.withColumn("_w", F.expr(f"regexp_extract_all(name, {_WORD}, 0)"))
    return words.select("name", F.size("_w").alias("n"), F.col("_w")[0].alias("first")).distinct()


def words_of(text: str) -> Column:
    """words, gaps (one more than words) and starts of a text."""
    return F.expr(f"""transform(transform(array(struct(
        regexp_extract_all({text}, {_WORD}, 0) AS words, split({text}, {_WORD}, -1) AS gaps)),
      t -> struct(t.words AS words, t.gaps AS gaps, zip_with(t.words, slice(t.gaps, 1, size(t.words)),
        (w, g) -> length(w) + length(g)) AS lens)),
      t -> struct(t.words AS words, t.gaps AS gaps, zip_with(t.words, {running_totals("t.lens")},
        (w, stop) -> stop - length(w)) AS starts))[0]""")


def _runs_at(i: str, sizes: Sequence[int]) -> str:
    """SQL for the runs of words of column ``_words`` from word ``i``, longest first, with
    what stands between the words; a run beyond the text has a NULL name."""
    runs = []
    for n in sorted(sizes, reverse=True):
        rest = f"""array_join(zip_with(slice(_words.gaps, {i} + 2, {n - 1}), slice(_words.words, {i} + 2, {n - 1}),
            (g, w) -> concat(g, w)), '')"""
        name = f"_words.words[{i}]" if n == 1 else f"concat(_words.words[{i}], {rest})"
        runs.append(
            f"struct(_words.starts[{i}] AS span_start, CASE WHEN {i} + {n} <= size(_words.words) THEN {name} END AS name)"
        )
    return f"array({', '.join(runs)})"


def _names_inline(df: DataFrame, text: str, names: Sequence, sizes: Sequence[int], any_space: bool) -> DataFrame:
    if not names:
        return df.withColumn("_names", F.lit(None).cast(pii.PII_HITS))
    firsts, listed = sorted({r["first"] for r in names}), [r["name"] for r in names]
    words = settle(df.withColumn("_words", words_of(text)), "_words")
    # Only words that begin a name are looked at further.
    placed = F.transform("_words.words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    begun = words.withColumn("_at", F.filter(placed, lambda p: p["w"].isin(firsts)))
    runs = settle(
        begun.withColumn("_runs", F.expr(f"flatten(transform(_at, p -> {_runs_at('p.i', sizes)}))")), "_runs"
    ).drop("_at", "_words")
    form = F.expr(f"transform(_runs, r -> struct(r.span_start, r.name, {_compared('r.name', any_space)} AS form))")
    known = runs.withColumn("_runs", F.filter(form, lambda r: r["form"].isin(listed)))
    return settle(known.withColumn("_names", _longest("_runs", sizes)), "_names").drop("_runs")


def _longest(runs: str, sizes: Sequence[int]) -> Column:
    """Hits of runs (by start, longest first) that no longer one covers.

    Only an earlier run can cover, and only one that begins within a name's words.
    """
    reach = max(sizes) * len(sizes)
    return F.expr(f"""CAST(transform(array(transform({runs}, r -> struct(r.span_start AS span_start,
        {len(pii.RECOGNISERS)} AS position, r.span_start + length(r.name) AS span_end,
        {literal(pii.PERSON)} AS entity, {pii.PERSON_SCORE}D AS score, r.name AS matched))), hits ->
      filter(hits, (h, i) -> NOT exists(slice(hits, greatest(i + 1 - {reach}, 1), least(i, {reach})),
        g -> g.span_end >= h.span_end)))[0] AS {pii.PII_HITS})""")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def name_hits(texts: DataFrame, text: str, names: DataFrame, sizes: Sequence[int], any_space: bool) -> DataFrame:
    """(_text, _names): PERSON hits of every distinct text with one, by a join with a long
    names table. ``_text`` is the text's SHA-256."""
    once = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_content")).distinct()
    words = settle(once.withColumn("_words", words_of("_content")), "_words")
    begins = words.select(_digest("_content").alias("_text"), "_words").withColumn(
        "_runs", F.expr(f"flatten(transform(_words.words, (x, i) -> {_runs_at('i', sizes)}))")
    )
    runs = begins.select("_text", F.explode("_runs").alias("r")).select("_text", "r.*").where("name IS NOT NULL")
    runs = runs.withColumn("form", F.expr(_compared("name", any_space)))
    forms = names.select(F.col("name").alias("form"))
    hits = lookup_join(runs, forms, "form", F.struct("_text", "span_start"), "left_semi")
    order = F.struct("span_start", (-F.length("name")).alias("order"), "name")
    listed = hits.groupBy("_text").agg(F.array_sort(F.collect_list(order)).alias("_all"))
    return listed.select("_text", _longest("_all", sizes).alias("_names"))


def explode_findings(df: DataFrame, *keep: str, findings: str = "findings") -> DataFrame:
    """One row per finding with the stable keys."""
    return df.select(*keep, F.posexplode(findings).alias("finding_no", "f")).select(
        *keep, "finding_no", "f.kind", "f.label", "f.severity",
        "f.span_start", "f.span_end", "f.preview",
    )
