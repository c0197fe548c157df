"""Outlines from headings, and page layout: boxes, body text, captions, visuals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.sql import blank, query

# Fixed patterns of headings: (family, pattern, level, ambiguous), tried in this order
NUMERALS = "〇零一二三四五六七八九十百千0-9"
KEYWORDS = "序|自序|代序|原序|序言|弁言|引言|前言|绪言|绪论|导言|导论|结语|结论|后记|跋|题记|附录|参考文献|致谢|凡例|出版说明|内容提要|内容简介|编者的话|目\\s*录"
WORDS = "一-龥A-Za-z0-9·《》〔〕（）()—\\-"
RULES = [
    ("keyword", f"^(?:{KEYWORDS})$", 0, False),
    ("volume", f"^第[{NUMERALS}]+(?:部分|编|篇|卷)", 0, False),
    ("chapter", f"^第[{NUMERALS}]+章", 1, False),
    ("section", f"^第[{NUMERALS}]+节", 2, False),
    ("signed_preface", "^(?:[一-龥]{1,2}(?:序|跋)|.{1,34}[（(](?:代序|序言|序|跋)[）)])$", 0, False),
    ("short_title", f"^(?:记|论|谈|说)(?![得着住载录者述])[{WORDS}]{{1,12}}$", 2, False),
    ("short_title", f"^[{WORDS}]{{2,20}}(?:记|碑|铭|表|志)$", 2, False),
    ("cn_dunhao", "^[一二三四五六七八九十百]+、", 3, True),
    ("cn_paren", "^[（(][一二三四五六七八九十百]+[）)]", 4, True),
    ("multi_level", "^[0-9]+(?:\\.[0-9]+)+[.、]?", 4, True),
    ("cn_bracket", "^[（(][0-9]+[）)]", 5, True),
    ("number_dot", "^[0-9]+[.、](?:\\s|$)", 5, True),
    ("circled", "^[①-⑳]", 6, True),
]
BREAKS, ENDS, PAGE_TAIL = "[。！？!?；;，,]", "[。！？!?；;，,、：:]$", "[／/]\\s*\\d{1,4}\\s*$"
CONTENTS, BARE_UNIT = "(?i)^(?:目\\s*录|contents|table\\s+of\\s+contents)$", f"^第[{NUMERALS}]+(?:部分|编|篇|卷|章|节)$"
MOST, MOST_AMBIGUOUS, MOST_SUBTITLE = 40, 24, 32


def classify_headings(pages: DataFrame) -> DataFrame:
    """Non-blank lines (page_id, document_id, page_number, line, title, start, end) with the family, level and ambiguity of those that are headings."""
    lines = query(
        f"""SELECT document_id, page_id, page_number, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS line, regexp_replace(raw, r'(?U)^\\s+|\\s+$', '') AS title,
                   before + length(raw) - length(regexp_replace(raw, r'(?U)^\\s+', '')) AS start
            FROM (SELECT document_id, page_id, page_number, pos, raw, coalesce(sum(length(raw) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                  FROM (SELECT document_id, page_id, page_number, posexplode(split(text, '\\n')) AS (pos, raw) FROM {{p}})) WHERE NOT {blank('raw')}""",
        p=pages,
    )
    flat = F.regexp_replace("title", r"(?U)\s+", " ")
    out = (F.length(flat) > MOST) | flat.rlike(ENDS) | flat.rlike(BREAKS) | flat.rlike(PAGE_TAIL)
    family, level, ambiguous = F.when(out, None), F.when(out, None), F.when(out, None)
    for name, pattern, depth, unsure in RULES:
        # the first rule that fits decides, even if it then refuses a title as too long
        fits, none = flat.rlike(pattern), unsure and (F.length(flat) > MOST_AMBIGUOUS)
        family = family.when(fits, F.when(none, None).otherwise(name) if unsure else F.lit(name))
        level = level.when(fits, F.when(none, None).otherwise(depth) if unsure else F.lit(depth))
        ambiguous = ambiguous.when(fits, F.lit(unsure))
    return lines.withColumn("end", F.col("start") + F.length("title")).withColumn("title", flat).withColumns({"family": family, "level": level, "ambiguous": ambiguous})


def toc_pages(headings: DataFrame) -> DataFrame:
    """Pages that are tables of contents."""
    return query(
        f"""SELECT page_id FROM {{h}} GROUP BY page_id
            HAVING bool_or(line = 0 AND title rlike r'{CONTENTS}') OR (count(family) >= 5 AND 2 * count(family) >= count(*))""".replace("{1,4}", "{{1,4}}"),
        h=headings,
    )


def build_outline(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline items of each document: (document_id, item, title, level, page_id, page_number, start, end), offsets in UTF-16."""
    kept = headings.join(toc_pages(headings), "page_id", "left_anti")
    neighbour = query(
        f"""SELECT * FROM (
              SELECT *, lead(struct(line, title, end, family)) OVER (PARTITION BY page_id ORDER BY line) AS next FROM {{k}}) WHERE family IS NOT NULL""",
        k=kept,
    )
    near = query(
        """SELECT *, coalesce(ambiguous AND ((before.ambiguous AND before.family = family AND before.line = line - 1) OR (after.ambiguous AND after.family = family AND after.line = line + 1)), false) AS in_list
           FROM (SELECT *, lag(struct(line, family, ambiguous)) OVER (PARTITION BY page_id ORDER BY line) AS before, lead(struct(line, family, ambiguous)) OVER (PARTITION BY page_id ORDER BY line) AS after FROM {n})""",
        n=neighbour,
    )
    follows = (F.col("next.line") == F.col("line") + 1) & F.col("title").rlike(BARE_UNIT) & F.col("next.family").isNull() & (F.length("next.title") <= MOST_SUBTITLE) & ~F.col("next.title").rlike(BREAKS) & ~F.col("next.title").rlike(ENDS)
    follows = F.coalesce(follows, F.lit(False))
    titled = near.where("NOT in_list").select("document_id", "page_id", "page_number", "line", "level", F.when(follows, F.concat_ws(" ", "title", "next.title")).otherwise(F.col("title")).alias("title"), "start", F.when(follows, F.col("next.end")).otherwise(F.col("end")).alias("end"))
    wide = "regexp_count(left(p.text, cast(t.{} AS int)), '[\\\\x{{{{10000}}}}-\\\\x{{{{10FFFF}}}}]')"
    titled = query(f"SELECT t.document_id, t.page_id, t.page_number, t.line, t.level, t.title, t.start + {wide.format('start')} AS start, t.end + {wide.format('end')} AS end FROM {{t}} t JOIN {{p}} p ON t.page_id = p.page_id", t=titled, p=pages.select("page_id", "text"))

    def settle(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in rows:
            if not (kept and kept[-1]["title"] == r["title"] and r["page_number"] - kept[-1]["page_number"] <= 1):
                kept.append(dict(r))
        dense = {level: i + 1 for i, level in enumerate(sorted({r["level"] for r in kept}))}
        return [r | {"item": f"outline-{i + 1:03d}", "level": dense[r["level"]]} for i, r in enumerate(kept)]

    @F.pandas_udf("array<struct<item: string, title: string, level: int, page_id: string, page_number: int, start: long, end: long>>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda rows: settle(list(rows)))

    # headings of one document: a short list
    per_document = query("SELECT document_id, sort_array(collect_list(struct(page_number, line, page_id, level, title, start, end))) AS rows FROM {t} GROUP BY document_id", t=titled)
    return per_document.select("document_id", F.explode(run("rows")).alias("i")).select("document_id", "i.*")


def outline_coverage(pages: DataFrame, items: DataFrame) -> DataFrame:
    return query(
        f"""SELECT p.document_id, count_if(NOT {blank('p.text')}) AS text_pages, count(*) AS total_pages, count_if(NOT {blank('p.text')}) = count(*) AS complete, coalesce(max(i.n), 0) AS items
            FROM {{p}} p LEFT JOIN (SELECT document_id, count(*) AS n FROM {{i}} GROUP BY document_id) i ON p.document_id = i.document_id GROUP BY p.document_id""",
        p=pages,
        i=items,
    )


def normalize_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (id, width, height, bbox array<double> or polygon array<array<double>>) as x1, y1, x2, y2; null when not finite, empty or off the page."""
    from_polygon = "array(array_min(transform(polygon, p -> p[0])), array_min(transform(polygon, p -> p[1])), array_max(transform(polygon, p -> p[0])), array_max(transform(polygon, p -> p[1])))"
    good = "size(b) = 4 AND forall(b, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND b[0] >= 0 AND b[1] >= 0 AND b[2] <= width AND b[3] <= height AND b[0] < b[2] AND b[1] < b[3]"
    return query(f"SELECT id, if({good}, b[0], NULL) AS x1, if({good}, b[1], NULL) AS y1, if({good}, b[2], NULL) AS x2, if({good}, b[3], NULL) AS y2 FROM (SELECT *, coalesce(bbox, {from_polygon}) AS b FROM {{b}})", b=boxes)


def layout_lines_to_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Each line's block: the first by order whose box holds the line's centre."""
    return query(
        """SELECT l.page_id, l.line_id, min_by(b.block_id, b.block_order) AS block_id FROM {l} l LEFT JOIN {b} b
           ON l.page_id = b.page_id AND (l.x1 + l.x2) / 2 BETWEEN b.x1 AND b.x2 AND (l.y1 + l.y2) / 2 BETWEEN b.y1 AND b.y2 GROUP BY l.page_id, l.line_id""",
        l=lines,
        b=blocks,
    )


#: Roles of blocks that are not body text.
NOT_BODY = ("header", "footer", "page_number", "footnote", "figure", "table", "caption", "seal")


def layout_body_text(blocks: DataFrame) -> DataFrame:
    """Body blocks (page_id, block_id, block_order, role, text) joined by line feeds, with where each begins and ends."""
    skip = ", ".join(f"'{r}'" for r in NOT_BODY)
    shown = blocks.where(f"role NOT IN ({skip}) AND text <> ''").select("page_id", "block_order", "block_id", "text")
    return query(
        """SELECT a.page_id, b.body, a.block_id, a.end - length(a.text) AS start, a.end
           FROM (SELECT *, cast(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY block_order, block_id, text ROWS UNBOUNDED PRECEDING) - 1 AS int) AS end FROM {b}) a
           JOIN (SELECT page_id, array_join(transform(sort_array(collect_list(struct(block_order, block_id, text))), x -> x.text), '\n') AS body FROM {b} GROUP BY page_id) b ON a.page_id = b.page_id""",
        b=shown,
    )


def attach_captions(blocks: DataFrame) -> DataFrame:
    """Each caption's visual on its page: by id, else by place, else the only neighbour in reading order.

    `blocks`: page_id, block_id, block_order, role (figure, table, caption, …), target, x1, y1, x2,
    y2, width, height, line_height. Pages are small; each is settled in one group.
    """

    def settle(rows: list[dict]) -> list[dict]:
        visuals = [r for r in rows if r["role"] in ("figure", "table")]
        out = []
        for c in (r for r in rows if r["role"] == "caption"):
            found, how = None, "unassigned"
            if c["target"] and any(v["block_id"] == c["target"] for v in visuals):
                found, how = c["target"], "id"
            placed = []
            for v in visuals if found is None and c["x1"] is not None else []:
                if v["x1"] is None:
                    continue
                slack = 0.02 * c["width"]
                gap = c["y1"] - v["y2"] if c["y1"] >= v["y2"] else v["y1"] - c["y2"]
                reach = max(3 * c["line_height"], 0.02 * c["height"])
                if c["x1"] >= v["x1"] - slack and c["x2"] <= v["x2"] + slack and 0 <= gap <= reach * 1.3:
                    below = c["y1"] >= v["y2"]
                    placed.append((below != (v["role"] == "figure"), gap, v["block_id"]))
            placed.sort()
            if placed and not (len(placed) > 1 and placed[0][0] == placed[1][0] and abs(placed[0][1] - placed[1][1]) <= 2):
                found, how = placed[0][2], "place"
            if found is None and not placed:
                at = rows.index(c)
                near = [r for r in rows[max(0, at - 1) : at + 2] if r["role"] in ("figure", "table")]
                if len(near) == 1:
                    found, how = near[0]["block_id"], "order"
            out.append({"caption_id": c["block_id"], "visual_id": found, "how": how})
        return out

    @F.pandas_udf("array<struct<caption_id: string, visual_id: string, how: string>>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda rows: settle(list(rows)))

    fields = "block_order, block_id, role, target, x1, y1, x2, y2, width, height, line_height"
    per_page = query(f"SELECT page_id, sort_array(collect_list(struct({fields}))) AS rows FROM {{b}} GROUP BY page_id", b=blocks)
    return per_page.select("page_id", F.explode(run("rows")).alias("c")).select("page_id", "c.*")


def visual_catalog(blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """One row per visual, numbered by page and order, its captions as title. `captions`: visual_id, block_order, text."""
    return query(
        """SELECT b.document_id, b.block_id, row_number() OVER (PARTITION BY b.document_id ORDER BY b.page_number, b.block_order) AS number, coalesce(c.title, '') AS title
           FROM {b} b LEFT JOIN (SELECT visual_id, array_join(transform(sort_array(collect_list(struct(block_order, text))), x -> x.text), ' ') AS title FROM {c} GROUP BY visual_id) c ON b.block_id = c.visual_id
           WHERE b.role IN ('figure', 'table')""",
        b=blocks,
        c=captions,
    )


def align_sentences_to_lines(pages: DataFrame) -> DataFrame:
    """Sentences of `displayed` and the recognised `lines` array<struct<id, text>> that hold them."""

    @F.pandas_udf("array<struct<id: string, lines: array<string>, kind: string, confidence: double>>")
    def run(shown: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([kernels.align(s or "", [dict(x) for x in ([] if r is None else r)]) for s, r in zip(shown, lines)])

    found = pages.withColumn("a", F.explode(run("displayed", "lines")))
    return found.select("page_id", F.col("a.id").alias("sentence_id"), F.col("a.lines").alias("line_ids"), "a.kind", "a.confidence")
