"""Merges, deletes, copies, folder trees and integrity. Each job gives the new snapshot of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import query
from ..functions.staging import staged


def merge_documents(stored: DataFrame, incoming: DataFrame, owner_id: int) -> DataFrame:
    """Upsert of one owner's batch (document_id, title, position): rows of other owners stay, versions go up, deleted rows come back."""
    return query(
        f"""SELECT coalesce(s.document_id, i.document_id) AS document_id, coalesce(s.owner_id, {owner_id}) AS owner_id, if({{take}}, i.title, s.title) AS title, if({{take}}, coalesce(s.version, 0) + 1, s.version) AS version,
                   if({{take}}, i.position, s.sort_order) AS sort_order, if({{take}}, false, s.is_deleted) AS is_deleted
            FROM {{s}} s FULL OUTER JOIN (SELECT document_id, max_by(title, position) AS title, max(position) AS position FROM {{i}} WHERE trim(document_id) <> '' GROUP BY document_id) i ON s.document_id = i.document_id""".replace(
            "{take}", f"(i.document_id IS NOT NULL AND (s.document_id IS NULL OR s.owner_id = {owner_id}))"
        ),
        s=stored,
        i=incoming,
    )


def merge_pages(stored: DataFrame, incoming: DataFrame, sweep: bool = True) -> DataFrame:
    """Upsert by page (page_id, document_id, text); a page of another document stays; with sweep, pages that a document's batch lacks are deleted."""
    gone = "i.page_id IS NULL AND t.document_id IS NOT NULL" if sweep else "false"
    take = "(i.page_id IS NOT NULL AND (s.page_id IS NULL OR s.document_id = i.document_id))"
    return query(
        f"""SELECT coalesce(s.page_id, i.page_id) AS page_id, coalesce(s.document_id, i.document_id) AS document_id, if({take}, i.text, s.text) AS text, if({take}, coalesce(s.version, 0) + 1, s.version) AS version,
                   if({take}, false, s.is_deleted OR ({gone})) AS is_deleted
            FROM {{s}} s FULL OUTER JOIN {{i}} i ON s.page_id = i.page_id LEFT JOIN (SELECT DISTINCT document_id FROM {{i}}) t ON s.document_id = t.document_id""",
        s=stored,
        i=incoming,
    )


def merge_conversations(stored: DataFrame, incoming: DataFrame, listed: DataFrame) -> DataFrame:
    """Attachments (conv_id, attachment_id, name, is_deleted) after a batch: listed ones are updated, others of the same conversations deleted."""
    return query(
        """SELECT coalesce(s.conv_id, l.conv_id) AS conv_id, coalesce(s.attachment_id, l.attachment_id) AS attachment_id, coalesce(l.name, s.name) AS name, CASE WHEN l.conv_id IS NOT NULL THEN false WHEN i.conv_id IS NOT NULL THEN true ELSE s.is_deleted END AS is_deleted
           FROM {s} s FULL OUTER JOIN {l} l ON s.conv_id = l.conv_id AND s.attachment_id = l.attachment_id LEFT JOIN (SELECT DISTINCT conv_id FROM {i}) i ON s.conv_id = i.conv_id""",
        s=stored,
        i=incoming,
        l=listed,
    )


def soft_delete(documents: DataFrame, pages: DataFrame, files: DataFrame, jobs: DataFrame, ids: DataFrame, owner_id: int) -> DataFrame:
    """(kind, id, action) of the rows that deleting an owner's documents takes along: documents, their live pages and files are deleted, their jobs cancelled.

    Ids are trimmed and distinct. `files`: file_id, document_id, is_deleted; `jobs`: document_id; `pages` may have is_deleted.
    """
    live = "WHERE NOT p.is_deleted" if "is_deleted" in pages.columns else ""
    return query(
        f"""WITH gone AS (SELECT d.document_id FROM {{d}} d LEFT SEMI JOIN (SELECT DISTINCT trim(document_id) AS id FROM {{i}} WHERE trim(document_id) <> '') i ON d.document_id = i.id WHERE d.owner_id = {owner_id} AND NOT d.is_deleted)
            SELECT 'document' AS kind, document_id AS id, 'deleted' AS action FROM gone
            UNION ALL SELECT 'page', p.page_id, 'deleted' FROM {{p}} p LEFT SEMI JOIN gone g ON p.document_id = g.document_id {live}
            UNION ALL SELECT 'file', f.file_id, 'deleted' FROM {{f}} f LEFT SEMI JOIN gone g ON f.document_id = g.document_id WHERE NOT f.is_deleted
            UNION ALL SELECT 'job', j.document_id, 'cancelled' FROM {{j}} j LEFT SEMI JOIN gone g ON j.document_id = g.document_id""",
        d=documents,
        p=pages,
        f=files,
        j=jobs,
        i=ids,
    )


def retire_failed_pages(documents: DataFrame, pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents' omitted and failed pages after requests (document_id, page_number) drop pages that carry a failure stage."""
    return query(
        """SELECT d.document_id, array_sort(array_union(d.omitted, coalesce(g.gone, array()))) AS omitted, array_except(d.failed, coalesce(g.gone, array())) AS failed
           FROM {d} d LEFT JOIN (SELECT p.document_id, collect_list(p.page_number) AS gone FROM {p} p LEFT SEMI JOIN {w} w ON p.document_id = w.document_id AND p.page_number = w.page_number WHERE p.failure_stage IS NOT NULL GROUP BY p.document_id) g
             ON d.document_id = g.document_id""",
        d=documents,
        p=pages,
        w=wanted,
    )


def reset_failed_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs (document_id, status, failures, retry_at) with failed ones of the requests queued again."""
    reset = "(w.document_id IS NOT NULL AND j.status = 'failed')"
    return query(
        f"SELECT j.document_id, if({reset}, 'queued', j.status) AS status, if({reset}, 0, j.failures) AS failures, if({reset}, 0, j.retry_at) AS retry_at FROM {{j}} j LEFT JOIN (SELECT DISTINCT document_id FROM {{w}}) w ON j.document_id = w.document_id",
        j=jobs,
        w=wanted,
    )


def retire_visual_files(files: DataFrame, visuals: DataFrame) -> DataFrame:
    """Live `page-visual:*` files of extracted pages without a ready visual. `visuals`: page_id, visual_id (null if none), status."""
    return query(
        """SELECT f.file_id FROM (SELECT f.* FROM {f} f LEFT SEMI JOIN {v} p ON f.page_id = p.page_id WHERE f.role LIKE 'page-visual:%' AND NOT f.is_deleted) f
           LEFT ANTI JOIN (SELECT page_id, visual_id FROM {v} WHERE status = 'ready') v ON f.page_id = v.page_id AND f.role = concat('page-visual:', v.visual_id)""",
        f=files,
        v=visuals,
    )


def user_snapshot(documents: DataFrame, pages: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """What a user sees: live own and public documents with owner name, edit right and pages, in order; foreign owner ids are hidden.

    The order is by sort_order, then the latest updated_at, then id. Documents are numbered by ranges of
    it, each range after those before it.
    """
    seen = query(
        f"""SELECT d.document_id, u.name AS owner_name, d.owner_id = {user_id} AS can_edit, if(d.owner_id = {user_id}, d.owner_id, NULL) AS owner_id, d.sort_order, d.updated_at
            FROM {{d}} d JOIN {{u}} u ON d.owner_id = u.user_id AND NOT u.is_deleted WHERE NOT d.is_deleted AND (d.owner_id = {user_id} OR d.visibility = 'public')""",
        d=documents,
        u=users,
    )
    ranges = staged(seen.repartitionByRange("sort_order", F.desc("updated_at"), "document_id").withColumn("range", F.spark_partition_id()), "snapshot-ranges")
    # offsets: a row for each range
    return query(
        """SELECT r.document_id, r.owner_name, r.can_edit, r.owner_id, coalesce(p.pages, array()) AS pages, o.before + row_number() OVER (PARTITION BY r.range ORDER BY r.sort_order, r.updated_at DESC, r.document_id) AS position
           FROM {r} r JOIN (SELECT range, sum(n) OVER (ORDER BY range) - n AS before FROM (SELECT range, count(*) AS n FROM {r} GROUP BY range)) o ON r.range = o.range
           LEFT JOIN (SELECT document_id, sort_array(collect_list(struct(page_number, page_id))) AS pages FROM {p} GROUP BY document_id) p ON r.document_id = p.document_id""",
        r=ranges,
        p=pages,
    )


def user_conversations(conversations: DataFrame, shares: DataFrame, user_id: int) -> DataFrame:
    """A user's live conversations in order, each with its active share if it has one.

    `conversations`: conv_id, owner_id, is_deleted, sort_order, updated_at; `shares`: conv_id, token,
    selected_turns, active, is_deleted.
    """
    return query(
        f"""SELECT c.conv_id, c.owner_id, s.token, s.selected_turns, row_number() OVER (PARTITION BY c.owner_id ORDER BY c.sort_order, c.updated_at DESC, c.conv_id) AS position
            FROM {{c}} c LEFT JOIN (SELECT conv_id, min_by(token, token) AS token, min_by(selected_turns, token) AS selected_turns FROM {{s}} WHERE active AND NOT is_deleted GROUP BY conv_id) s ON c.conv_id = s.conv_id
            WHERE c.owner_id = {user_id} AND NOT c.is_deleted""",
        c=conversations,
        s=shares,
    )


def _copied(user_id: int, column: str) -> str:
    """The id that a user's copy of a row gets."""
    return f"left(sha2(concat_ws(':', {user_id}, {column}), 256), 32)"


def clone_documents(documents: DataFrame, pages: DataFrame, user_id: int) -> DataFrame:
    """Pages of copies of all public documents of others, under ids that follow from user and source."""
    return query(
        f"""SELECT {_copied(user_id, 'd.document_id')} AS document_id, {_copied(user_id, 'p.page_id')} AS page_id, p.page_number, d.document_id AS source_document_id, {user_id} AS owner_id,
                   if(bool_and(coalesce(p.punctuated_text, '') <> '') OVER (PARTITION BY d.document_id), 'complete', 'partial') AS status
            FROM {{d}} d JOIN {{p}} p ON d.document_id = p.document_id WHERE d.owner_id <> {user_id} AND d.visibility = 'public' AND NOT d.is_deleted""",
        d=documents,
        p=pages,
    )


def clone_headers(documents: DataFrame, pages: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """The copies themselves: private, with where they come from, who made the source and who copied it.

    `documents` may have `creator`; without one the owner's name counts. A copy is complete if it has pages
    and all of them have text.
    """
    creator = "coalesce(d.creator, o.name)" if "creator" in documents.columns else "o.name"
    return query(
        f"""SELECT {_copied(user_id, 'd.document_id')} AS document_id, {user_id} AS owner_id, 'private' AS visibility, d.title, d.document_id AS source_document_id, coalesce({creator}, 'unknown') AS creator, m.name AS modifier,
                   if(coalesce(p.complete, false), 'complete', 'partial') AS status
            FROM {{d}} d LEFT JOIN {{u}} o ON d.owner_id = o.user_id LEFT JOIN {{u}} m ON m.user_id = {user_id}
            LEFT JOIN (SELECT document_id, bool_and(coalesce(punctuated_text, '') <> '') AS complete FROM {{p}} GROUP BY document_id) p ON d.document_id = p.document_id
            WHERE d.owner_id <> {user_id} AND d.visibility = 'public' AND NOT d.is_deleted""",
        d=documents,
        u=users,
        p=pages,
    )


def clone_files(documents: DataFrame, pages: DataFrame, files: DataFrame, user_id: int) -> DataFrame:
    """File records of the copies: those of the document itself and those of pages that are copied, under the copies' ids.

    `files`: document_id, page_id (null for the document's own), role, sha256, size, is_deleted. The id is
    document, page and role.
    """
    page = f"if(f.page_id IS NULL, '', {_copied(user_id, 'f.page_id')})"
    return query(
        f"""SELECT concat_ws(':', {_copied(user_id, 'd.document_id')}, {page}, f.role) AS file_id, {_copied(user_id, 'd.document_id')} AS document_id, nullif({page}, '') AS page_id, f.role, f.sha256, f.size
            FROM {{f}} f JOIN {{d}} d ON f.document_id = d.document_id LEFT JOIN {{p}} p ON f.page_id = p.page_id AND f.document_id = p.document_id
            WHERE NOT f.is_deleted AND (f.page_id IS NULL OR p.page_id IS NOT NULL) AND d.owner_id <> {user_id} AND d.visibility = 'public' AND NOT d.is_deleted""",
        d=documents,
        p=pages,
        f=files,
    )


def latest_by_key(rows: DataFrame, keys: list[str], at: str, tie: str, keep: str = "true") -> DataFrame:
    """The last row of each key; keys whose last row fails `keep` are left out."""
    key = ", ".join(keys)
    return query(f"SELECT last.* FROM (SELECT max_by(struct(*), struct({at}, {tie})) AS last FROM {{r}} GROUP BY {key}) WHERE {keep}", r=rows)


def _jumped(reach: DataFrame, rounds: int) -> DataFrame:
    """`up` (and `least`, if there is one: the least met on the way) after 2 ** rounds steps."""
    least = ", least(a.least, coalesce(b.least, a.least)) AS least" if "least" in reach.columns else ""
    for _ in range(rounds):
        reach = staged(query(f"SELECT a.owner_id, a.folder_id, b.up{least} FROM {{r}} a LEFT JOIN {{r}} b ON a.owner_id = b.owner_id AND a.up = b.folder_id", r=reach), "folder-reach")
        if not least and reach.where("up IS NOT NULL").isEmpty():
            break
    return reach


def folder_tree(folders: DataFrame, members: DataFrame, visible: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Repaired folders (owner_id, folder_id, parent_id, name) and memberships (owner_id, folder_id, document_id, position).

    Unknown and self parents become the root. A cycle is broken at the member where the way up from
    the least folder that leads into it arrives; folders that only lead into a cycle keep their
    parent. Of a repeated folder the row of least parent and name counts. Each way up doubles its
    reach per round, so rounds grow with the log of the depth.
    """
    once = query("SELECT * EXCEPT (n) FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, folder_id ORDER BY parent_id NULLS FIRST, name) AS n FROM {f}) WHERE n = 1", f=folders)
    base = query(
        """SELECT f.owner_id, f.folder_id, left(trim(f.name), 80) AS name, if(f.parent_id = f.folder_id OR p.folder_id IS NULL, NULL, f.parent_id) AS parent_id
           FROM {f} f LEFT JOIN {f} p ON f.owner_id = p.owner_id AND f.parent_id = p.folder_id""",
        f=once,
    )
    base = staged(base, "folders")
    rounds = min(most_rounds, max(1, base.count().bit_length()))
    reach = _jumped(base.select("owner_id", "folder_id", F.col("parent_id").alias("up")), rounds)
    # after more steps than there are folders, whoever still has an ancestor has one on a cycle, and every member of a cycle is one
    on = staged(query("SELECT DISTINCT owner_id, up AS folder_id FROM {r} WHERE up IS NOT NULL", r=reach), "folder-cycles")
    below = query("SELECT b.owner_id, b.folder_id, b.parent_id, o.folder_id IS NOT NULL AS member FROM {b} b LEFT SEMI JOIN {r} r ON b.owner_id = r.owner_id AND b.folder_id = r.folder_id AND r.up IS NOT NULL LEFT JOIN {o} o ON b.owner_id = o.owner_id AND b.folder_id = o.folder_id", b=base, r=reach, o=on)
    below = staged(below, "folder-below")
    # the member where each folder's way meets its cycle, and the least member of each cycle
    meets = _jumped(below.select("owner_id", "folder_id", F.when(F.col("member"), F.col("folder_id")).otherwise(F.col("parent_id")).alias("up")), rounds)
    cycle = _jumped(below.where("member").select("owner_id", "folder_id", F.col("parent_id").alias("up"), F.least("folder_id", "parent_id").alias("least")), rounds)
    cut = query("SELECT m.owner_id, min_by(m.up, m.folder_id) AS folder_id FROM {m} m JOIN {c} c ON m.owner_id = c.owner_id AND m.up = c.folder_id GROUP BY m.owner_id, c.least", m=meets, c=cycle)
    tree = query("SELECT b.owner_id, b.folder_id, b.name, if(c.folder_id IS NOT NULL, NULL, b.parent_id) AS parent_id FROM {b} b LEFT JOIN {c} c ON b.owner_id = c.owner_id AND b.folder_id = c.folder_id", b=base, c=cut)
    first = query(
        """SELECT m.owner_id, m.folder_id, m.document_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, document_id ORDER BY position) AS n FROM {m}) m LEFT SEMI JOIN {v} v ON m.document_id = v.document_id
           LEFT SEMI JOIN {f} f ON m.owner_id = f.owner_id AND m.folder_id = f.folder_id WHERE m.n = 1""",
        m=members,
        v=visible,
        f=base,
    )
    return tree, first


def folder_rollup(tree: DataFrame, members: DataFrame, documents: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """Documents of each folder and all below it, how deep it lies, how far down it reaches, and the names on the way from the root.

    With `documents` (owner_id, document_id), a row without folder_id for each owner: all of the
    owner's documents that lie in a folder, and those in none, which count at the root.

    A round knows each folder's ancestor 2 ** k steps up and the sums over all less than 2 ** k steps
    below; each folder adds its sums to that ancestor's. So a tree of depth d takes log d rounds of
    one join and one aggregation with a row for each folder, and no pairs of folder and ancestor are made.
    """
    path = ", array(t.name) AS path" if paths else ""
    now = query(
        f"""SELECT t.owner_id, t.folder_id, t.parent_id AS up, coalesce(m.n, 0) AS documents, 0L AS height, if(t.parent_id IS NULL, 0L, 1L) AS depth{path}
            FROM {{t}} t LEFT JOIN (SELECT owner_id, folder_id, count(*) AS n FROM {{m}} GROUP BY owner_id, folder_id) m ON t.owner_id = m.owner_id AND t.folder_id = m.folder_id""",
        t=tree,
        m=members,
    )
    now, step = staged(now, "rollup"), 1
    path = ", if(u.folder_id IS NULL, t.path, concat(u.path, t.path)) AS path" if paths else ""
    while not now.where("up IS NOT NULL").isEmpty():
        further = query(
            f"""SELECT t.owner_id, t.folder_id, u.up, t.documents + coalesce(b.documents, 0) AS documents, greatest(t.height, coalesce(b.height, 0)) AS height, t.depth + coalesce(u.depth, 0) AS depth{path}
                FROM {{t}} t LEFT JOIN {{t}} u ON t.owner_id = u.owner_id AND t.up = u.folder_id
                LEFT JOIN (SELECT owner_id, up AS folder_id, sum(documents) AS documents, max(height) + {step} AS height FROM {{t}} WHERE up IS NOT NULL GROUP BY owner_id, up) b ON t.owner_id = b.owner_id AND t.folder_id = b.folder_id""",
            t=now,
        )
        now, step = staged(further, "rollup"), 2 * step
    found = now.drop("up").withColumn("unfiled", F.lit(None).cast("long"))
    if documents is None:
        return found
    top = query(
        f"""SELECT d.owner_id, NULL AS folder_id, count(*) AS documents, max(coalesce(h.height, 0)) AS height, 0L AS depth{", cast(array() AS array<string>) AS path" if paths else ""}, count_if(m.document_id IS NULL) AS unfiled
            FROM {{d}} d LEFT JOIN (SELECT DISTINCT owner_id, document_id FROM {{m}}) m ON d.owner_id = m.owner_id AND d.document_id = m.document_id
            LEFT JOIN (SELECT owner_id, max(depth) + 1 AS height FROM {{t}} GROUP BY owner_id) h ON d.owner_id = h.owner_id GROUP BY d.owner_id""",
        d=documents,
        m=members,
        t=now,
    )
    return found.unionByName(top)


def integrity_report(files: DataFrame, content: DataFrame) -> DataFrame:
    """Live file records (file_id, path, sha256, size) against stored bytes (path, content): ok, missing, size or checksum. Sizes and hashes are worked out where the bytes lie, so only those are joined."""
    return query(
        """SELECT f.file_id, CASE WHEN c.path IS NULL THEN 'missing' WHEN c.size <> f.size THEN 'size' WHEN c.sha256 <> f.sha256 THEN 'checksum' ELSE 'ok' END AS finding
           FROM {f} f LEFT JOIN (SELECT path, octet_length(content) AS size, sha2(content, 256) AS sha256 FROM {c}) c ON f.path = c.path WHERE NOT f.is_deleted""",
        f=files,
        c=content,
    )


def orphan_check(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, id) of child keys without a parent; each relation is name, child, its key, parent, its key."""
    parts = [c.select(F.lit(name).alias("relation"), F.col(ck).cast("string").alias("id")).where("id IS NOT NULL").distinct().join(p.select(F.col(pk).cast("string").alias("id")), "id", "left_anti").select("relation", "id") for name, c, ck, p, pk in relations]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def expired_uploads(uploads: DataFrame, now: int, hours: int = 24) -> DataFrame:
    return query(f"SELECT upload_id FROM {{u}} WHERE status <> 'registered' AND updated_at < {now} - {hours * 3600}", u=uploads)
