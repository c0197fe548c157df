"""Corpus tables: documents, users and pages, read with typed columns or derived from flat texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import query

DOCUMENT_PAYLOAD = "title string, author string, year string, publisher string, tags array<string>, fileName string, provenance struct<creator: string, modifier: string, sourceDocumentId: string>, processingTask struct<status: string, totalPages: int>"
PAGE_PAYLOAD = "ocrText string, normalizedText string, punctuationDraftText string, punctuatedText string, notes string, processingRevision int, visuals array<struct<id: string, kind: string, blockOrder: int, captions: array<struct<id: string, text: string>>>>"

#: Lines of a text that make one page of the derived corpus.
PAGE_LINES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(
        """SELECT concat('doc-', doc_id) AS document_id, cast(doc_id % 7 + 1 AS int) AS owner_id, if(doc_id % 3 = 0, 'public', 'private') AS visibility,
                  doc_id % 23 = 0 AS is_deleted, cast(doc_id AS int) AS sort_order, concat('Title ', doc_id) AS title, source AS author,
                  cast(1900 + doc_id % 50 AS string) AS year, lang AS publisher, text
           FROM {d}""",
        d=table(spark, sf_dir, "documents"),
    )


def corpus_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("SELECT DISTINCT owner_id AS user_id, concat('user ', owner_id) AS name, owner_id = 7 AS is_deleted FROM {d}", d=corpus_documents(spark, sf_dir))


def paged(documents: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """One row per page of `lines` lines; cut within the row, without a shuffle."""
    starts = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("l", i * lines + 1, F.lit(lines)), "\n"))
    split = documents.where("text IS NOT NULL").select("document_id", F.split("text", "\n").alias("l"))
    return split.select("document_id", F.posexplode(cut).alias("i", "page_text"))


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(
        """SELECT concat(document_id, '-p', i + 1) AS page_id, document_id, i + 1 AS page_number, replace(page_text, ',', '') AS ocr_text,
                  if((i + 1) % 4 = 0, NULL, page_text) AS punctuated_text, if((i + 1) % 5 = 0, substring(page_text, 1, 40), '') AS notes
           FROM {p}""",
        p=paged(corpus_documents(spark, sf_dir)),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests from the benchmark texts: three words, one word, or two characters."""
    return query(
        """SELECT item_id AS query_id, cast(item_id % 7 + 1 AS int) AS user_id,
                  CASE item_id % 3 WHEN 0 THEN array_join(slice(split(text, ' '), 1, 3), ' ') WHEN 1 THEN split(text, ' ')[0] ELSE substring(text, 1, 2) END AS query
           FROM {b}""",
        b=table(spark, sf_dir, "benchmark"),
    )


def page_payloads(pages: DataFrame) -> DataFrame:
    """Pages as the store keeps them: ids and one JSON payload."""
    payload = F.to_json(F.struct(F.col("ocr_text").alias("ocrText"), F.col("punctuated_text").alias("punctuatedText"), "notes"))
    return pages.select("page_id", "document_id", "page_number", payload.alias("payload"))


def document_payloads(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "owner_id", "visibility", "is_deleted", "sort_order", F.to_json(F.struct("title", "author", "year", "publisher")).alias("payload"))


def load_corpus(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Typed rows, one per page, from documents and pages with JSON payloads; a page's payload is what counts for text."""
    d = documents.withColumn("d", F.from_json("payload", DOCUMENT_PAYLOAD)).drop("payload")
    p = pages.withColumn("p", F.from_json("payload", PAGE_PAYLOAD)).drop("payload")
    return query(
        """SELECT p.document_id, p.page_id, p.page_number, d.owner_id, d.visibility, d.is_deleted, d.d.title, d.d.author, d.d.year, d.d.publisher,
                  p.p.ocrText AS ocr_text, p.p.punctuatedText AS punctuated_text, p.p.notes
           FROM {p} p JOIN {d} d ON p.document_id = d.document_id""",
        p=p,
        d=d,
    )


#: Version of the tables that snapshots are made from and read into.
SCHEMA_VERSION = 9


def export_snapshot(documents: DataFrame, pages: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """One record per live document, its pages nested in order of number, and per live conversation of a known user; owners are kept.

    `conversations`: conv_id, owner_id, is_deleted, turns array<struct<turn, role, text>>.
    """
    return query(
        f"""SELECT 'document' AS kind, d.document_id AS id, d.owner_id, d.title, coalesce(g.pages, array()) AS pages, NULL AS turns, {SCHEMA_VERSION} AS schema_version
            FROM {{d}} d LEFT JOIN (
              SELECT document_id, sort_array(collect_list(struct(page_number, page_id, ocr_text, punctuated_text, notes))) AS pages FROM {{p}} GROUP BY document_id) g
              ON d.document_id = g.document_id
            WHERE NOT d.is_deleted
            UNION ALL SELECT 'conversation', cast(c.conv_id AS string), c.owner_id, NULL, NULL, c.turns, {SCHEMA_VERSION} FROM {{c}} c LEFT SEMI JOIN {{u}} u ON c.owner_id = u.user_id WHERE NOT c.is_deleted""",
        d=documents,
        p=pages,
        c=conversations,
        u=users,
    )


def _readable(records: DataFrame, users: DataFrame, kind: str) -> DataFrame:
    """Records of a kind with a known owner; a record of another schema version is an error."""
    wrong = f"concat('snapshot of schema version ', coalesce(cast(schema_version AS string), 'none'), ', not {SCHEMA_VERSION}')"
    checked = records.where(F.expr(f"if(schema_version <=> {SCHEMA_VERSION}, true, cast(raise_error({wrong}) AS boolean))"))
    return query(f"SELECT r.* FROM {{r}} r LEFT SEMI JOIN {{u}} u ON r.owner_id = u.user_id WHERE r.kind = '{kind}'", r=checked, u=users)


def import_snapshot(records: DataFrame, users: DataFrame) -> DataFrame:
    """Page rows of the document records of known owners."""
    return query(
        """SELECT r.id AS document_id, r.owner_id, r.title, p.page_id, p.page_number, p.ocr_text, p.punctuated_text, p.notes
           FROM {r} r LATERAL VIEW inline(r.pages) p AS page_number, page_id, ocr_text, punctuated_text, notes""",
        r=_readable(records, users, "document"),
    )


def import_conversations(records: DataFrame, users: DataFrame) -> DataFrame:
    """Turns of the conversation records of known owners."""
    return query("SELECT r.id AS conv_id, r.owner_id, t.turn, t.role, t.text FROM {r} r LATERAL VIEW inline(r.turns) t AS turn, role, text", r=_readable(records, users, "conversation"))
