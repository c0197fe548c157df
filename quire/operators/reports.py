"""Pipeline and index reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sql import blank, query


def index_coverage(expected: DataFrame, vectors: DataFrame, failed: DataFrame) -> DataFrame:
    """Per document, pages indexed, failed and pending. `expected`: document_id, page_id, chunks; `vectors`: page_id per chunk; `failed`: page_id."""
    return query(
        """SELECT document_id, count_if(done) AS indexed, count_if(NOT done AND bad) AS failed, greatest(0, count(*) - count_if(done) - count_if(NOT done AND bad)) AS pending FROM (
             SELECT e.document_id, e.chunks > 0 AND coalesce(v.n, 0) = e.chunks AS done, f.page_id IS NOT NULL AS bad
             FROM {e} e LEFT JOIN (SELECT page_id, count(*) AS n FROM {v} GROUP BY page_id) v ON e.page_id = v.page_id LEFT JOIN (SELECT DISTINCT page_id FROM {f}) f ON e.page_id = f.page_id) GROUP BY document_id""",
        e=expected,
        v=vectors,
        f=failed,
    )


STAGES = ("ocr", "variant", "punctuation", "finalize")


def stage_progress(pages: DataFrame) -> DataFrame:
    """Per document and stage, pages past it of all. `pages`: document_id, page_id, status map<string,string>, omitted boolean.

    A page is past a stage that is done, failed or skipped, or that comes after a failed ocr or variant.
    """
    blocked = {s: " OR ".join(f"status['{b}'] = 'failed'" for b in ("ocr", "variant")[: STAGES.index(s)]) or "false" for s in STAGES}
    rows = ", ".join(f"struct('{s}' AS stage, coalesce(omitted OR status['{s}'] IN ('done', 'failed', 'skipped') OR {blocked[s]}, false) AS past)" for s in STAGES)
    return query(f"SELECT document_id, stage, count_if(past) AS done, count(*) AS total FROM (SELECT document_id, inline(array({rows})) FROM {{p}}) GROUP BY document_id, stage", p=pages)


def failed_pages(pages: DataFrame) -> DataFrame:
    """Documents with their failed pages in order: page, stage and message."""
    return query("SELECT document_id, sort_array(collect_list(struct(page_number, stage, message))) AS failures FROM {p} WHERE stage IS NOT NULL GROUP BY document_id", p=pages)


def preparation_state(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per document with sources or jobs that are not all ready: stage by priority, jobs ready and in all, percent, and how many failed.

    `jobs`: document_id and status of each; `sources`: document_id of live pages with text. A
    document without jobs yet waits in the queue.
    """
    return query(
        """SELECT document_id, CASE WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'queued' WHEN waiting > 0 THEN 'waiting' WHEN failed > 0 THEN 'failed' ELSE 'queued' END AS stage, ready, total,
                  if(total = 0, 25, least(99, 25 + cast(bround(75 * ready / total) AS int))) AS percent, failed
           FROM (SELECT coalesce(j.document_id, s.document_id) AS document_id, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, running, pending, waiting, coalesce(failed, 0) AS failed
                 FROM (SELECT document_id, count(*) AS total, count_if(status = 'ready') AS ready, count_if(status = 'running') AS running, count_if(status = 'pending') AS pending, count_if(status = 'waiting') AS waiting, count_if(status = 'failed') AS failed FROM {j} GROUP BY document_id) j
                 FULL OUTER JOIN (SELECT DISTINCT document_id FROM {s}) s ON j.document_id = s.document_id)
           WHERE total = 0 OR ready < total""",
        j=jobs,
        s=sources,
    )


def preparation_candidates(documents: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Copies (source_document_id set) with unfinished jobs, or with sources and no job."""
    return query(
        """SELECT DISTINCT d.document_id, d.owner_id FROM {d} d LEFT SEMI JOIN (
             SELECT document_id FROM {j} WHERE status <> 'ready' UNION ALL SELECT s.document_id FROM {s} s LEFT ANTI JOIN {j} j ON s.document_id = j.document_id) c ON d.document_id = c.document_id
           WHERE d.source_document_id IS NOT NULL""",
        d=documents,
        s=sources,
        j=jobs,
    )


def live_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Live rows of each table (with is_deleted)."""
    parts = " UNION ALL ".join(f"SELECT '{name}' AS kind, count_if(NOT is_deleted) AS live FROM {{{name}}}" for name in tables)
    return query(parts, **tables)


def document_status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The managed task's status, else the registration's, else by how many pages have text."""
    return query(
        f"""SELECT d.document_id, coalesce(nullif(d.task_status, ''), nullif(d.registration, ''), CASE WHEN coalesce(p.some, false) = false THEN 'no text' WHEN p.every THEN 'saved' ELSE 'in progress' END) AS status
            FROM {{d}} d LEFT JOIN (SELECT document_id, bool_or(NOT {blank('punctuated_text')}) AS some, bool_and(NOT {blank('punctuated_text')}) AS every FROM {{p}} GROUP BY document_id) p ON d.document_id = p.document_id""",
        d=documents,
        p=pages,
    )


def metadata_candidate_text(pages: DataFrame, first: int = 3) -> DataFrame:
    """The first pages' text with page headers, how many were read, of how many."""
    return query(
        f"""SELECT document_id, array_join(transform(array_sort(collect_list(struct(page_number, ocr_text)) FILTER (WHERE page_number <= {first})), x -> concat('[', x.page_number, ']\n', x.ocr_text)), '\n\n') AS text,
                   count_if(page_number <= {first}) AS pages_read, count(*) AS pages_total FROM {{p}} GROUP BY document_id""",
        p=pages,
    )


def attachment_report(attachments: DataFrame) -> DataFrame:
    """Per conversation (conv_id, status, text, warnings array<string>)."""
    return query(
        f"""SELECT conv_id, count_if(status IN ('uploading', 'processing')) AS pending, count_if(status = 'ready' AND NOT {blank('text')}) AS ready, count_if(status = 'failed' OR (status = 'ready' AND {blank('text')})) AS failed,
                   array_sort(array_distinct(flatten(collect_list(warnings)))) AS warnings FROM {{a}} GROUP BY conv_id""",
        a=attachments,
    )


def derived_index_status(pages: DataFrame, derived: DataFrame, version: int) -> DataFrame:
    """Per page: unavailable, stale (another revision, text or version) or what is stored."""
    return query(
        f"""SELECT p.page_id, CASE WHEN d.page_id IS NULL THEN 'unavailable' WHEN NOT (d.revision <=> p.revision AND d.text_hash <=> p.text_hash AND d.version <=> {version}) THEN 'stale' ELSE d.status END AS status
            FROM {{p}} p LEFT JOIN {{d}} d ON p.page_id = d.page_id""",
        p=pages,
        d=derived,
    )


def conversation_groups(conversations: DataFrame, now: str) -> DataFrame:
    """Groups by age (conv_id, created, updated): within 30 days, by month, or unfiled; most recent first."""
    return query(
        f"""SELECT conv_id, CASE WHEN at IS NULL THEN 'unfiled' WHEN at >= timestamp'{now}' - INTERVAL 30 DAYS THEN 'within 30 days' ELSE date_format(at, 'yyyy-MM') END AS label, row_number() OVER (PARTITION BY owner_id ORDER BY at DESC NULLS LAST, conv_id) AS position
            FROM (SELECT conv_id, owner_id, coalesce(updated, created) AS at FROM {{c}})""",
        c=conversations,
    )
