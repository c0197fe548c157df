"""Filters and joins: visibility, anchors, evidence checks, earlier pages, field merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import blank, query
from ..functions.staging import in_blocks, staged


def live_pages(pages: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """Pages of live documents of live owners, with owner and visibility."""
    return query(
        """SELECT p.page_id, p.document_id, p.page_number, d.owner_id, d.visibility
           FROM {p} p JOIN {d} d ON p.document_id = d.document_id LEFT SEMI JOIN {u} u ON d.owner_id = u.user_id AND NOT u.is_deleted WHERE NOT d.is_deleted""",
        p=pages,
        d=documents,
        u=users,
    )


def visible_scope(requests: DataFrame, pages: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """(query_id, page_id) that the request's user may see: public or own, live throughout, within the id list if there is one.

    An empty list allows nothing, a null list all. Own documents come by an equi-join; public ones
    belong to every request, a stated set.
    """
    live = live_pages(pages, documents, users)
    return in_blocks(requests, lambda block: _visible_scope(block, live))


def _visible_scope(requests: DataFrame, live: DataFrame) -> DataFrame:
    return query(
        """SELECT r.query_id, p.page_id, p.document_id FROM {p} p JOIN {r} r ON p.owner_id = r.user_id WHERE p.visibility <> 'public' AND (r.document_ids IS NULL OR array_contains(r.document_ids, p.document_id))
           UNION ALL
           SELECT /*+ BROADCAST(r) */ r.query_id, p.page_id, p.document_id FROM {p} p JOIN {r} r ON r.document_ids IS NULL OR array_contains(r.document_ids, p.document_id) WHERE p.visibility = 'public'""",
        p=live,
        r=requests,
    )


def visible_rows(rows: DataFrame, requests: DataFrame, pages: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """Rows (query_id, page_id, …) whose page the request's user may see, as visible_scope says, without making that table."""
    return query(
        """SELECT w.* FROM {w} w JOIN {r} r ON w.query_id = r.query_id JOIN {p} p ON w.page_id = p.page_id
           WHERE (p.visibility = 'public' OR p.owner_id = r.user_id) AND (r.document_ids IS NULL OR array_contains(r.document_ids, p.document_id))""",
        w=rows,
        r=requests,
        p=live_pages(pages, documents, users),
    )


#: What a request sees: public pages, and those that are its user's own.
SEES = "array('public', concat('user ', user_id))"


def scope_bitmaps(pages: DataFrame, documents: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live pages with a number and a scope (`public`, or their owner), and for each scope bitmaps of its page numbers.

    Numbers follow document and page by ranges, so a document's pages lie in one or two bitmaps of
    32,768 pages. Public pages are held once, private ones once for their owner, whatever the number
    of requests.
    """
    scoped = live_pages(pages, documents, users).withColumn("scope", F.expr("if(visibility = 'public', 'public', concat('user ', owner_id))"))
    ranges = staged(scoped.repartitionByRange("document_id", "page_number", "page_id").withColumn("range", F.spark_partition_id()), "scope-ranges")
    # offsets: a row for each range
    numbered = query(
        """SELECT r.page_id, r.document_id, r.scope, o.before + row_number() OVER (PARTITION BY r.range ORDER BY r.document_id, r.page_number, r.page_id) AS number
           FROM {r} r JOIN (SELECT range, sum(n) OVER (ORDER BY range) - n AS before FROM (SELECT range, count(*) AS n FROM {r} GROUP BY range)) o ON r.range = o.range""",
        r=ranges,
    )
    numbered = staged(numbered, "scope-pages")
    bits = query("SELECT scope, bitmap_bucket_number(number) AS bucket, bitmap_construct_agg(bitmap_bit_position(number)) AS bits FROM {n} GROUP BY scope, bitmap_bucket_number(number)", n=numbered)
    return numbered, bits


def probe_scopes(rows: DataFrame, requests: DataFrame, numbered: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows (query_id, page_id, …) of pages whose bit is set in one of the bitmaps that the request sees, within its id list if there is one."""
    return query(
        f"""SELECT w.* FROM (SELECT struct(w.*) AS w, explode({SEES}) AS scope, n.number, bitmap_bucket_number(n.number) AS bucket
              FROM {{w}} w JOIN {{r}} r ON w.query_id = r.query_id JOIN {{n}} n ON w.page_id = n.page_id WHERE r.document_ids IS NULL OR array_contains(r.document_ids, n.document_id)) p
            JOIN {{b}} b ON p.scope = b.scope AND p.bucket = b.bucket
            WHERE shiftright(cast(conv(hex(substring(b.bits, cast(bitmap_bit_position(p.number) div 8 AS int) + 1, 1)), 16, 10) AS int), cast(bitmap_bit_position(p.number) % 8 AS int)) & 1 = 1""",
        w=rows,
        r=requests,
        n=numbered,
        b=bits,
    )


def visible_page_counts(requests: DataFrame, numbered: DataFrame, bits: DataFrame) -> DataFrame:
    """(query_id, pages): how many pages each request may see, from the bitmaps; from its documents where it names some."""
    return query(
        f"""SELECT r.query_id, coalesce(a.pages, 0) + coalesce(l.pages, 0) AS pages FROM {{r}} r
            LEFT JOIN (SELECT q.query_id, sum(b.pages) AS pages FROM (SELECT query_id, explode({SEES}) AS scope FROM {{r}} WHERE document_ids IS NULL) q
                       JOIN (SELECT scope, sum(bitmap_count(bits)) AS pages FROM {{b}} GROUP BY scope) b ON q.scope = b.scope GROUP BY q.query_id) a ON r.query_id = a.query_id
            LEFT JOIN (SELECT q.query_id, count(*) AS pages FROM (SELECT query_id, user_id, explode(array_distinct(document_ids)) AS document_id FROM {{r}}) q
                       JOIN {{n}} n ON q.document_id = n.document_id AND array_contains({SEES}, n.scope) GROUP BY q.query_id) l ON r.query_id = l.query_id""",
        r=requests,
        b=bits,
        n=numbered,
    )


def verify_anchors(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits whose layer, hash, bounds and text still hold, one per place, with UTF-16 offsets.

    `hits`: query_id, page_id, source_layer, source_hash, start, end, match_start, match_end, text, level.
    """
    astral = r"regexp_count(substring(s.text, 1, {}), '[\\x{{{{10000}}}}-\\x{{{{10FFFF}}}}]')"
    return query(
        f"""SELECT query_id, page_id, source_layer, level, start, end, start + wide_start AS start_utf16, end + wide_end AS end_utf16 FROM (
              SELECT h.query_id, h.page_id, h.source_layer, h.level, h.start, h.end, {astral.format('h.start')} AS wide_start, {astral.format('h.end')} AS wide_end,
                     row_number() OVER (PARTITION BY h.query_id, h.page_id, h.source_layer, h.level, h.start, h.end ORDER BY h.match_start) AS n
              FROM {{h}} h JOIN {{s}} s ON h.page_id = s.page_id AND h.source_layer = s.source_layer AND h.source_hash = s.source_hash
              WHERE h.start >= 0 AND h.end <= length(s.text) AND h.start < h.end AND substring(s.text, h.start + 1, h.end - h.start) = h.text AND h.match_start >= h.start AND h.match_end <= h.end) WHERE n = 1""",
        h=hits,
        s=sources,
    )


def reader_filter(matches: DataFrame, pages: DataFrame, levels: list[str], first: int, last: int) -> DataFrame:
    """Matches of the levels on pages `first` to `last`, counted by position in the document."""
    chosen = ", ".join(f"'{x}'" for x in levels)
    return query(
        f"""SELECT m.*, p.position FROM {{m}} m JOIN (SELECT page_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_id) AS position FROM {{p}}) p
            ON m.page_id = p.page_id WHERE m.level IN ({chosen}) AND p.position BETWEEN {first} AND {last}""",
        m=matches,
        p=pages,
    )


#: Layers that evidence may name, besides captions of visuals.
KNOWN_LAYERS = "'ocrText', 'punctuatedText', 'notes'"
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def validate_evidence(locators: DataFrame, sources: DataFrame) -> DataFrame:
    """Locators, already of visible pages, with the current hash of their layer, and whether they are of an earlier text."""
    return query(
        f"""SELECT l.query_id, l.page_id, l.source_layer, l.source_hash, coalesce(s.source_hash, '{EMPTY_HASH}') AS current_hash, coalesce(s.source_hash, '{EMPTY_HASH}') <> l.source_hash AS historical
            FROM {{l}} l LEFT JOIN {{s}} s ON l.page_id = s.page_id AND l.source_layer = s.source_layer
            WHERE l.source_layer IN ({KNOWN_LAYERS}) OR l.source_layer LIKE 'visual_caption:%'""",
        l=locators,
        s=sources,
    )


def drop_stale_hits(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with `fresh`: their source still has the hash they were found under; and, per query, how many are stale."""
    return query(
        """SELECT h.*, s.page_id IS NOT NULL AS fresh, count_if(s.page_id IS NULL) OVER (PARTITION BY h.query_id) AS stale_hits
           FROM {h} h LEFT JOIN (SELECT DISTINCT page_id, source_layer, source_hash FROM {s}) s ON h.page_id = s.page_id AND h.source_layer = s.source_layer AND h.source_hash = s.source_hash""",
        h=hits,
        s=sources,
    )


#: Places of a page that are swept together.
SWEEP = 4096


def suppress_overlaps(semantic: DataFrame, literal: DataFrame) -> DataFrame:
    """Semantic hits that no literal range of the same query, page and layer overlaps.

    A hit is overlapped if, of the ranges that begin before it ends, the one that reaches furthest
    passes its start: a running maximum over places in order. Places are swept SWEEP at a time, and
    what earlier stretches reach comes as one row each, so neither pairs of hit and range are made nor
    is a page with very many of them one task.
    """
    key = "query_id, page_id, source_layer"
    # a range that begins where a hit ends comes after it
    events = query(
        f"""SELECT {key}, end AS at, 0 AS kind, cast(NULL AS bigint) AS reach, struct(*) AS hit FROM {{s}}
            UNION ALL SELECT {key}, match_start, 1, cast(match_end AS bigint), NULL FROM {{l}}""",
        s=semantic,
        l=literal,
    ).withColumn("stretch", F.expr(f"cast(at AS bigint) div {SWEEP}"))
    earlier = query(
        f"""SELECT {key}, stretch, max(reach) OVER (PARTITION BY {key} ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
            FROM (SELECT {key}, stretch, max(reach) AS reach FROM {{e}} GROUP BY {key}, stretch)""",
        e=events,
    )
    swept = query(
        f"""SELECT x.hit, x.up_to, r.earlier FROM (SELECT *, max(reach) OVER (PARTITION BY {key}, stretch ORDER BY at, kind ROWS UNBOUNDED PRECEDING) AS up_to FROM {{e}}) x
            JOIN {{r}} r ON {" AND ".join(f"x.{c} = r.{c}" for c in [*key.split(", "), "stretch"])}""",
        e=events,
        r=earlier,
    )
    return swept.where("hit IS NOT NULL AND coalesce(greatest(up_to, earlier) <= hit.start, true)").select("hit.*")


def reference_scope_report(selected: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Per conversation (conv_id, owner_id, document_id rows): ids that are missing, without processed text, or processed in part."""
    return query(
        f"""SELECT c.conv_id, count_if(d.document_id IS NULL) AS missing, count_if(d.document_id IS NOT NULL AND coalesce(p.done, 0) = 0) AS unprocessed, count_if(p.done > 0 AND p.done < p.pages) AS partial
            FROM {{c}} c LEFT JOIN (SELECT * FROM {{d}} WHERE NOT is_deleted) d ON c.document_id = d.document_id AND c.owner_id = d.owner_id
            LEFT JOIN (SELECT document_id, count(*) AS pages, count_if(NOT {blank('punctuated_text')}) AS done FROM {{p}} GROUP BY document_id) p ON d.document_id = p.document_id
            GROUP BY c.conv_id""",
        c=selected,
        d=documents,
        p=pages,
    )


def previous_page_tail(pages: DataFrame, characters: int = 300) -> DataFrame:
    """For each page, the end of the nearest earlier page of its document that has any processed text.

    A page's text is its punctuated text, else its draft, else its normalised text, stripped; blank
    text gives nothing. `pages`: page_id, document_id, page_number, punctuated_text, draft_text, normalized_text.
    """
    ends = r"(?U)^\s+|\s+$"
    return query(
        rf"""SELECT page_id, CASE WHEN length(before) > {characters} THEN concat('…… ', regexp_replace(right(before, {characters}), r'(?U)^\s+', '')) ELSE coalesce(before, '') END AS tail FROM (
              SELECT page_id, regexp_replace(last(text, true) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r'{ends}', '') AS before
              FROM (SELECT *, coalesce(nullif(punctuated_text, ''), nullif(draft_text, ''), nullif(normalized_text, '')) AS text FROM {{p}}))""",
        p=pages,
    )


def merge_metadata(documents: DataFrame, extracted: DataFrame, fields: tuple[str, ...] = ("title", "author", "year", "publisher")) -> DataFrame:
    """Documents whose blank fields are filled from extraction."""
    filled = ", ".join(f"CASE WHEN {blank('d.' + f)} THEN coalesce(e.{f}, d.{f}) ELSE d.{f} END AS {f}" for f in fields)
    return query(f"SELECT d.document_id, {filled} FROM {{d}} d LEFT JOIN {{e}} e ON d.document_id = e.document_id", d=documents, e=extracted)


def three_way_merge(stored: DataFrame, baseline: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fields and page text of a client's copy against what is stored.

    `stored`: page_id, revision, page_revision, title, text, notes, active (its job still runs),
    proofread; `baseline`: page_id, title; `incoming`: page_id, revision, page_revision, title, text,
    notes, null for what the client did not send.

    With the stored revision the client's title counts; with another one only where a baseline shows
    that the client changed it. The text counts if the page's own revision is the stored one and no
    job works on the page, or it has been proofread; notes always. A missing revision is 0 in
    store and older than any at a client.
    """
    current = "coalesce(i.revision, -1) = coalesce(s.revision, 0)"
    own_text = "i.text IS NOT NULL AND (NOT coalesce(s.active, false) OR coalesce(s.proofread, false)) AND coalesce(i.page_revision, -1) = coalesce(s.page_revision, 0)"
    return query(
        f"""SELECT s.page_id, CASE WHEN i.page_id IS NULL THEN s.title WHEN {current} OR (b.title IS NOT NULL AND coalesce(i.title, '') <> b.title) THEN i.title ELSE coalesce(s.title, '') END AS title,
                  CASE WHEN i.page_id IS NOT NULL AND {own_text} THEN i.text ELSE s.text END AS text, coalesce(i.notes, s.notes) AS notes
           FROM {{s}} s LEFT JOIN {{i}} i ON s.page_id = i.page_id LEFT JOIN {{b}} b ON s.page_id = b.page_id""",
        s=stored,
        i=incoming,
        b=baseline,
    )
