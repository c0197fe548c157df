"""Registered queries over the test tables, and the SQL that a second engine checks them with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The derived views, in the checking engine's SQL.
VIEWS = {
    "cd": """SELECT 'doc-'||doc_id AS document_id, CAST(doc_id%7+1 AS INTEGER) AS owner_id, CASE WHEN doc_id%3=0 THEN 'public' ELSE 'private' END AS visibility,
  doc_id%23=0 AS is_deleted, CAST(doc_id AS INTEGER) AS sort_order, 'Title '||doc_id AS title, source AS author, CAST(1900+doc_id%50 AS VARCHAR) AS year, lang AS publisher, text FROM documents""",
    "cu": "SELECT DISTINCT owner_id AS user_id, 'user '||owner_id AS name, owner_id = 7 AS is_deleted FROM cd",
    "lines": "SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cd",
    "cp0": "SELECT document_id, CAST((i-1)//8+1 AS INTEGER) AS page_number, string_agg(line, chr(10) ORDER BY i) AS page_text FROM lines GROUP BY 1, 2",
    "cp": """SELECT document_id||'-p'||page_number AS page_id, document_id, page_number, replace(page_text, ',', '') AS ocr_text,
  CASE WHEN page_number%4=0 THEN NULL ELSE page_text END AS punctuated_text, CASE WHEN page_number%5=0 THEN substr(page_text,1,40) ELSE '' END AS notes FROM cp0""",
    "rq": """SELECT item_id AS query_id, CAST(item_id%7+1 AS INTEGER) AS user_id,
  CASE item_id%3 WHEN 0 THEN array_to_string(list_slice(string_split(text,' '),1,3),' ') WHEN 1 THEN string_split(text,' ')[1] ELSE substr(text,1,2) END AS query FROM benchmark""",
    "src": """SELECT document_id, page_id, page_number, 'ocrText' AS source_layer, ocr_text AS text FROM cp WHERE trim(ocr_text, E' \\n\\t\\r') <> ''
  UNION ALL SELECT document_id, page_id, page_number, 'punctuatedText', punctuated_text FROM cp WHERE trim(punctuated_text, E' \\n\\t\\r') <> ''
  UNION ALL SELECT document_id, page_id, page_number, 'notes', notes FROM cp WHERE trim(notes, E' \\n\\t\\r') <> ''""",
    "prim": """SELECT document_id, page_id, page_number, CASE WHEN trim(punctuated_text, E' \\n\\t\\r') <> '' THEN 'punctuatedText' ELSE 'ocrText' END AS source_layer,
  CASE WHEN trim(punctuated_text, E' \\n\\t\\r') <> '' THEN punctuated_text ELSE ocr_text END AS text FROM cp WHERE trim(punctuated_text, E' \\n\\t\\r') <> '' OR trim(ocr_text, E' \\n\\t\\r') <> ''""",
}
NEEDS = {"cu": ["cd"], "lines": ["cd"], "cp0": ["cd", "lines"], "cp": ["cd", "lines", "cp0"], "src": ["cd", "lines", "cp0", "cp"], "prim": ["cd", "lines", "cp0", "cp"]}


def with_views(sql: str, names: str) -> str:
    order: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    sql = sql.strip()
    if not head:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"


def job(oracle: str | None = None, views: str = ""):
    """Register a query under its function's name, with the checking SQL over the named views."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = with_views(oracle, views)
        return f

    return wrap
