"""Scalar text jobs: layers, normal forms, sentences, snippets, dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.sql import blank, chars, content, lower_words, query
from ..functions.staging import in_blocks, staged

#: Layers by policy, in order of preference.
POLICIES = {"primary": ("punctuated_text", "ocr_text"), "processed": ("punctuated_text",), "reader": ("punctuated_text",)}
LAYER_NAMES = {"punctuated_text": "punctuatedText", "ocr_text": "ocrText", "notes": "notes"}
PARTIAL_DATE = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?$"


def primary_layer(policy: str = "primary") -> str:
    """SQL: the name of the first layer of the policy that is not blank, or null."""
    return f"CASE {' '.join(f"WHEN NOT {blank(n)} THEN '{LAYER_NAMES[n]}'" for n in POLICIES[policy])} END"


def select_primary_text(pages: DataFrame, policy: str = "primary") -> DataFrame:
    """The first layer of the policy that is not blank; pages without one give no row."""
    text = " ".join(f"WHEN NOT {blank(n)} THEN {n}" for n in POLICIES[policy])
    return query(f"SELECT * FROM (SELECT document_id, page_id, page_number, {primary_layer(policy)} AS source_layer, CASE {text} END AS text FROM {{p}}) WHERE source_layer IS NOT NULL", p=pages)


def quoted(x: str) -> str:
    """Percent-encoding that leaves letters, digits and `-._~` only."""
    return f"replace(replace(replace(url_encode({x}), '+', '%20'), '*', '%2A'), '%7E', '~')"


def page_layers(pages: DataFrame) -> str:
    """SQL: (source_layer, text) of a page's layers and of the captions of its visuals, blank ones too."""
    has_visuals = "visuals" in pages.columns
    captions = f", transform(flatten(transform(coalesce(visuals, array()), v -> transform(coalesce(v.captions, array()), c -> struct(v.id AS v, c.id AS c, c.text AS t)))), x -> struct(concat('visual_caption:', {quoted('x.v')}, ':', {quoted('x.c')}) AS source_layer, x.t AS text))"
    layers = "array(" + ", ".join(f"struct('{LAYER_NAMES[n]}' AS source_layer, {n} AS text)" for n in ("ocr_text", "punctuated_text", "notes")) + ")"
    return f"concat({layers}{captions})" if has_visuals else layers


def explode_sources(pages: DataFrame) -> DataFrame:
    """One row per layer with text, and per caption of a visual, with the sha-256 of the text."""
    return query(
        f"""SELECT document_id, page_id, page_number, source_layer, sha2(text, 256) AS source_hash, text
            FROM (SELECT document_id, page_id, page_number, inline({page_layers(pages)}) FROM {{p}}) WHERE NOT {blank('text')}""",
        p=pages,
    )


# Names of the two scripts
VARIANTS = {
    "simplified": ("simplified", "s", "hans", "zh-hans", "zh-cn", "cn"),
    "traditional": ("traditional", "t", "hant", "zh-hant", "zh-tw", "zh-hk", "tw", "hk"),
}


def variant_of(name: str | None) -> str:
    """The script that a name means; simplified for none and for unknown names."""
    plain = (name or "").strip().lower()
    return next((v for v, names in VARIANTS.items() if plain in names), "simplified")


def variant_converter(tables: dict[str, tuple[dict[str, str], dict[str, str]]], variant: str | None = None):
    """A column function that converts texts to a script; null becomes empty.

    `tables`: for each script, the phrases and the characters that lead to it, dictionaries
    of bounded size that go with the function. Longer phrases go first, then characters; a script
    without tables changes nothing.
    """
    phrases, characters = tables.get(variant_of(variant), ({}, {}))

    @F.pandas_udf("string")
    def convert(text: pd.Series) -> pd.Series:
        return text.map(kernels.WordConverter(phrases, characters), na_action=None)

    return convert


def html_visible_text(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(kernels.visible_text, na_action="ignore")

    return run(column)


def decode_bytes(column: Column) -> Column:
    """Struct of a file's text, the encoding that it was read by (null if none reads it), and how many places were replaced."""

    @F.pandas_udf("struct<text: string, encoding: string, replaced: int>")
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.decode_bytes(x) for x in v], columns=["text", "encoding", "replaced"])

    return run(column)


def clean_text(df: DataFrame, column: str = "text", limit: int = 60_000) -> DataFrame:
    """Unescaped text with even line ends, no NUL, no blanks before line ends, at most one blank line; cut at `limit`."""

    @F.pandas_udf("string")
    def unescape(v: pd.Series) -> pd.Series:
        return v.map(kernels.unescape, na_action="ignore")

    x = F.regexp_replace(F.regexp_replace(unescape(F.coalesce(F.col(column), F.lit(""))), "\r\n?", "\n"), "\x00", "")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    trimmed = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    full = df.withColumn("_clean", trimmed)
    cut = F.length("_clean") > limit
    kept = F.when(cut, F.regexp_replace(F.substring("_clean", 1, limit), r"(?U)\s+$", "")).otherwise(F.col("_clean"))
    return full.withColumn("clean", kept).withColumn("truncated", cut).withColumn("warning", F.when(cut, F.lit(f"text was cut at {limit} characters"))).drop("_clean")


def normalize_layout_text(x: str) -> str:
    """SQL: each line stripped, runs of blank lines made one, none at the ends."""
    lines = f"transform(split(regexp_replace({x}, '\\r\\n?', '\\n'), '\\n'), l -> regexp_replace(l, r'(?U)^\\s+|\\s+$', ''))"
    return f"regexp_replace(regexp_replace(array_join({lines}, '\\n'), '\\n{{{{3,}}}}', '\\n\\n'), '^\\n+|\\n+$', '')"


def normalize_generated_text(column: Column) -> Column:
    """Even line ends; single ones joined (by a blank between Western words); at most one blank line."""
    x = F.regexp_replace(F.coalesce(column, F.lit("")), "\r\n?", "\n")
    x = F.when(~x.contains("\n") & x.contains("\\n"), F.replace(x, F.lit("\\n"), F.lit("\n"))).otherwise(x)
    x = F.regexp_replace(x, "[ \t]+\n", "\n")
    western = r"(?:(?<=[A-Za-z0-9])\n(?=[\x00-\x09\x0B-\x7F])|(?<=[\x00-\x09\x0B-\x7F])\n(?=[A-Za-z0-9]))"
    x = F.regexp_replace(F.regexp_replace(x, western, " "), r"(?<!\n)\n(?!\n)", "")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def content_stats(pages: DataFrame, column: str = "ocr_text") -> DataFrame:
    return query(
        rf"SELECT page_id, {content(column)} AS content, length({content(column)}) AS content_chars, regexp_count({column}, r'\p{{{{P}}}}') AS punctuation FROM {{p}} WHERE {column} IS NOT NULL",
        p=pages,
    )


def split_sentences(pages: DataFrame, column: str = "text") -> DataFrame:
    """One row per sentence with its UTF-16 range."""

    @F.pandas_udf("array<struct<id: string, text: string, start: int, end: int>>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(kernels.sentences)

    return pages.withColumn("s", F.explode(run(F.col(column)))).select("page_id", F.col("s.id").alias("sentence_id"), F.col("s.start").alias("start_utf16"), F.col("s.end").alias("end_utf16"), F.col("s.text").alias("sentence"))


def sentence_excerpt(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Adds sentence_start, sentence_end and sentence_text around a code-point range."""

    @F.pandas_udf("struct<a: int, b: int>")
    def run(t: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.excerpt(x, int(i), int(j)) for x, i, j in zip(t, a, b)], columns=["a", "b"], dtype="int32")

    found = df.withColumn("_e", run(text, start, end))
    return found.withColumn("sentence_start", F.col("_e.a")).withColumn("sentence_end", F.col("_e.b")).withColumn("sentence_text", F.substr(F.col(text), F.col("_e.a") + 1, F.col("_e.b") - F.col("_e.a"))).drop("_e")


def pack_text_chunks(column: Column, limit: int = 6000) -> Column:
    @F.pandas_udf("array<string>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda t: kernels.pack_chunks(t, limit))

    return run(column)


def split_attachment_text(column: Column, limit: int = 1600) -> Column:
    @F.pandas_udf("array<string>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda t: kernels.attachment_parts(t, limit))

    return run(column)


def relevance_score(text: str, wanted: str) -> str:
    """SQL: 1, and 3 for each term of the query that the text holds."""
    return f"(1 + 3 * size(filter({lower_words(wanted)}, t -> contains(lower({text}), t))))"


def snippet(text: str, wanted: str) -> str:
    """SQL: the first hit with 36 characters before and 72 after, '' without one."""
    at = f"(instr(lower({text}), lower({wanted})) - 1)"
    begin, end = f"greatest(0, {at} - 36)", f"least(length({text}), {at} + length({wanted}) + 72)"
    return f"CASE WHEN {at} < 0 THEN '' ELSE concat(if({begin} > 0, '...', ''), substring({text}, {begin} + 1, {end} - {begin}), if({end} < length({text}), '...', '')) END"


def parse_partial_date(x: str) -> dict[str, str]:
    """SQL expressions for valid, year, month and day of `YYYY[-MM[-DD]]`; month and day 0 when missing."""
    part = [f"cast(nullif(regexp_extract(trim({x}), '{PARTIAL_DATE}', {i}), '') AS int)" for i in (1, 2, 3)]
    part = [p.replace("{4}", "{{4}}").replace("{2}", "{{2}}") for p in part]
    y, m, d = part[0], f"coalesce({part[1]}, 0)", f"coalesce({part[2]}, 0)"
    real = f"({y} >= 1 AND {m} <= 12 AND ({part[1]} IS NULL OR {m} >= 1 OR {d} = 0) AND ({d} = 0 OR try_make_timestamp({y}, {m}, {d}, 0, 0, 0) IS NOT NULL))"
    return {"valid": f"coalesce({real}, false)", "year": y, "month": m, "day": d}


def date_label(gregorian: str, original: str) -> str:
    """SQL: the date in words, the original in brackets when it differs."""
    part = [f"cast(split({gregorian}, '-')[{i}] AS int)" for i in range(3)]
    words = f"CASE size(split({gregorian}, '-')) WHEN 3 THEN concat({part[0]}, '年', {part[1]}, '月', {part[2]}, '日') WHEN 2 THEN concat({part[0]}, '年', {part[1]}, '月') ELSE concat({part[0]}, '年') END"
    return f"CASE WHEN coalesce({gregorian}, '') = '' THEN coalesce(nullif({original}, ''), '日期待核') WHEN coalesce({original}, '') NOT IN ('', {words}) THEN concat({words}, '（', {original}, '）') ELSE {words} END"


def parse_llm_json(column: Column, schema: str) -> Column:
    """The object in a model's answer: without a code fence, else the outermost braces; null if there is none."""
    bare = F.regexp_replace(F.trim(column), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    whole = F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner)), schema)


def _pieces(x: str, longest: int = 3) -> str:
    """The distinct substrings of up to three characters of an array of characters, and the empty one."""
    parts = [f"transform(sequence(0, greatest(size({x}) - {n}, 0)), i -> array_join(slice({x}, i + 1, {n}), ''))" for n in range(1, longest + 1)]
    return f"array_union(array(''), array_distinct(concat({', '.join(parts)})))"


def shelf_search(documents: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, document_id) where every term of the query occurs in the document's fields, after NFKC and lower case.

    A document is listed under every substring of three characters, two or one of its fields, as far as
    queries have them in a term (three, where the term is long enough). A query looks under the one
    of its substrings that fewest documents have and tests what it finds there; a query without
    terms has the empty one, which all documents have. A block of queries is sent to all tasks; lists and
    shelves, which Spark takes for as small as the shelves' files, never are.
    """

    @F.pandas_udf("string")
    def fold(v: pd.Series) -> pd.Series:
        return v.map(kernels.nfkc_lower, na_action="ignore")

    shelf = documents.select("document_id", fold(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])).alias("shelf"))
    shelf = staged(shelf, "shelf")
    return in_blocks(wanted.select("query_id", "query"), lambda block: _shelf_search(shelf, block, fold), "query")


def _shelf_search(shelf: DataFrame, wanted: DataFrame, fold) -> DataFrame:
    terms = staged(wanted.select("query_id", F.filter(F.split(fold("query"), r"(?U)\s+"), lambda t: t != "").alias("terms")), "shelf-terms")
    asked = query(
        f"""SELECT query_id, terms, explode(if(size(terms) = 0, array(''), array_distinct(flatten(transform(terms, t ->
              if(length(t) < 3, array(t), transform(sequence(1, length(t) - 2), i -> substring(t, i, 3)))))))) AS piece FROM {{t}} WHERE terms IS NOT NULL""",
        t=terms,
    )
    listed = query(f"SELECT document_id, explode({_pieces('c')}) AS piece FROM (SELECT document_id, {chars('shelf')} AS c FROM {{s}})", s=shelf)
    listed = query("SELECT l.* FROM {l} l LEFT SEMI JOIN {a} a ON l.piece = a.piece", l=listed, a=asked.select("piece").distinct())
    rarest = query("SELECT a.query_id, any_value(a.terms) AS terms, min_by(a.piece, struct(coalesce(n.n, 0) AS n, a.piece)) AS piece FROM {a} a LEFT JOIN (SELECT piece, count(*) AS n FROM {l} GROUP BY piece) n ON a.piece = n.piece GROUP BY a.query_id", a=asked, l=listed)
    return query(
        "SELECT /*+ MERGE(f, s) */ f.query_id, s.document_id FROM {f} f JOIN {s} s ON f.document_id = s.document_id WHERE forall(f.terms, t -> contains(s.shelf, t))",
        f=query("SELECT /*+ BROADCAST(q) */ q.query_id, q.terms, l.document_id FROM {q} q JOIN {l} l ON q.piece = l.piece", q=rarest, l=listed),
        s=shelf,
    )
