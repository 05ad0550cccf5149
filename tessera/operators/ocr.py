"""Recognised pages as DataFrames: labels above titles, paragraphs that go over pages, bundles, notes and rich views.

Boxes are arrays of four numbers: left, top, right, bottom.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from tessera.operators.matching import grid_overlaps

#: The longest label, the part of the page for labels, an image's greatest width and height, the distance to its label.
LABEL_CHARS, TOP, ICON_WIDTH, ICON_HEIGHT, ICON_GAP = 60, 0.25, 120, 150, 50


def proper_box(box: Column) -> Column:
    """Four finite numbers that are not negative, with an area."""
    return (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))) & (F.get(box, 0) < F.get(box, 2)) & (F.get(box, 1) < F.get(box, 3))


def _apart(a: str, b: str, low: int) -> Column:
    """Whether two boxes don't share a stretch along one axis (0 across, 1 down)."""
    return F.greatest(F.get(a, low), F.get(b, low)) >= F.least(F.get(a, low + 2), F.get(b, low + 2))


def title_labels(headers: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, page, before, text, box: unique headers that label the one small image beside a title.

    ``headers``: doc_id, page, width, height, box, text (in units of the page); ``items``: doc_id, page, ordinal, type,
    text, level, box (in thousandths). ``before`` is the ordinal of the image that the label goes in front of. The
    images and titles of a page meet only within their page.
    """
    text = F.trim("text")
    scale = F.array("width", "height", "width", "height")
    once = F.count(F.lit(1)).over(Window.partitionBy("doc_id", F.lower(F.upper(text)))) == 1
    sized = headers.withColumn("once", once).where((F.col("width") > 0) & (F.col("height") > 0) & proper_box(F.col("box")))
    short = F.col("once") & text.rlike(r"\p{L}") & (F.length(text) <= LABEL_CHARS) & (F.get("box", 3) <= F.col("height") * TOP)
    scaled = F.zip_with(F.col("box"), scale, lambda v, s: v / s * 1000)
    labels = sized.where(short).select("doc_id", "page", text.alias("text"), scaled.alias("box")).where(F.forall("box", lambda v: v <= 1000))
    said = items.where("type = 'text'").select("doc_id", "page", F.trim("text").alias("text"))
    labels = labels.join(said, ["doc_id", "page", "text"], "left_anti")
    placed = items.where(proper_box(F.col("box")))
    titles = placed.where("type = 'text' and level = 1").select("doc_id", "page", F.col("box").alias("title"))
    width, height = F.get("icon", 2) - F.get("icon", 0), F.get("icon", 3) - F.get("icon", 1)
    icons = placed.where("type = 'image'").select("doc_id", "page", "ordinal", F.col("box").alias("icon")).where((width <= ICON_WIDTH) & (height <= ICON_HEIGHT))
    i, t = icons.alias("i"), titles.alias("t")
    beside = (F.get("title", 0) >= F.get("icon", 2)) & ~_apart("title", "icon", 1)
    icons = i.join(t, (F.col("i.doc_id") == F.col("t.doc_id")) & (F.col("i.page") == F.col("t.page")) & beside, "left_semi")
    gap = F.get("icon", 1) - F.get("box", 3)
    over = labels.join(icons, ["doc_id", "page"]).where(gap.between(0, ICON_GAP) & ~_apart("icon", "box", 0))
    found = over.groupBy("doc_id", "page", "text").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("before"), F.first("box").alias("box"))
    return found.where("n = 1").select("doc_id", "page", "before", "text", "box")


#: Kinds of paragraphs that can go over pages, kinds of spans in them.
FLOWING, SPANS = ("text", "index"), ("text", "inline_equation")
LINES = "array<struct<box:array<double>,starts_item:boolean,spans:array<struct<box:array<double>,kind:string,content:string,cross:boolean>>>>"
_WIDE = {c: c - 0xFEE0 for lo, hi in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(lo, hi + 1)}


def _escaped(content: str) -> str:
    """Wide letters and digits made plain; Markdown marks behind an even number of backslashes get one more."""
    return re.sub(r"(?<!\\)((?:\\\\)*)([*_`~$])", r"\1\\\2", content.translate(_WIDE))


def line_text(lines: list[dict], spaced: bool) -> str:
    """The paragraph that lines of spans make; with ``spaced`` lines are set apart by spaces and hyphens at line ends go."""
    out = []
    flat = [(k, s, i == len(line["spans"]) - 1) for k, line in enumerate(lines) for i, s in enumerate(line["spans"])]
    opening = {k: line["spans"][0] for k, line in enumerate(lines) if line["spans"]}
    begun = set()
    for k, span, last in flat:
        if k not in begun:
            begun.add(k)
            out += ["  \n"] if k and lines[k].get("starts_item") else []
        words = span["kind"] == "text"
        body = (_escaped(span["content"]) if words else span["content"] and f"${span['content']}$").strip()
        if not body:
            continue
        at_end = words and last
        if at_end and spaced and re.search(r"[A-Za-z][-\u00ad\u2010\u2011\u2043]$", body):
            nxt = opening.get(k + 1)
            out.append(body[:-1] if nxt and nxt["kind"] == "text" and _escaped(nxt["content"])[:1].islower() else body)
        else:
            out.append(body if at_end and not spaced else body + " ")
    return re.sub(r"\A([ \t]{0,3})(#{1,6}|[-+])(?=[ \t])", r"\1\\\2", "".join(out).rstrip())


@pandas_udf(ArrayType(StringType()))
def _readings(lines: pd.Series) -> pd.Series:
    """Both readings of lines as JSON: spaced, and not."""
    return lines.map(lambda x: None if x is None else [line_text(json.loads(x), spaced) for spaced in (True, False)])


def _measured(box: Column) -> Column:
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v)) & (F.get(box, 0) <= F.get(box, 2)) & (F.get(box, 1) <= F.get(box, 3)), F.lit(False))


def _sound(lines: Column) -> Column:
    span = lambda s: _measured(s["box"]) & s["kind"].isin(*SPANS) & s["content"].isNotNull()
    return F.coalesce((F.size(lines) > 0) & F.forall(lines, lambda x: _measured(x["box"]) & (F.size(x["spans"]) > 0) & F.forall(x["spans"], span)), F.lit(False))


def _crossing(lines: Column) -> Column:
    return F.coalesce(F.exists(F.flatten(F.transform(lines, lambda x: x["spans"])), lambda s: F.coalesce(s["cross"], F.lit(False))), F.lit(False))


def _without_marks(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(x["box"].alias("box"), F.transform(x["spans"], lambda s: F.struct(s["box"].alias("box"), s["kind"].alias("kind"), s["content"].alias("content"))).alias("spans")))


def page_texts(blocks: DataFrame, originals: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item, text, error: the text of each page of paragraphs that were merged over pages or blocks.

    ``blocks``: doc_id, page, ordinal, kind, box, index, deleted, lines (``LINES``), width, height; ``originals``, before
    the merge: doc_id, page, kind, box, index, lines; ``items``: doc_id, item, page, box (whole thousandths), text.
    A paragraph starts at a block with lines; deleted blocks behind it lost their lines to it. The lines must be those
    of the originals in order and marked where they leave the first page, and the items must say either the merged
    text or the parts. A document with anything else has rows with an error and no text. Without merges there are no rows.
    """
    merged_away, lines = F.coalesce("deleted", F.lit(False)), F.col("lines")
    has_lines = F.coalesce(F.size(lines) > 0, F.lit(False))
    b = blocks.withColumns({"gone": merged_away, "full": has_lines, "marked": merged_away | _crossing(lines), "flows": F.coalesce(F.col("kind").isin(*FLOWING), F.lit(False))})
    errors = lambda df, code: df.select("doc_id", F.lit(code).alias("error"))
    wrong = errors(b.where("marked and not flows"), "unsupported_kind")
    order = Window.partitionBy("doc_id").orderBy("page", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.col("full") & ~F.col("gone")
    flow = b.where("flows and (gone or full)").withColumn("chain", F.sum(owner.cast("int")).over(order))
    flow = flow.withColumn("owner_kind", F.last(F.when(owner, F.col("kind")), ignorenulls=True).over(order))
    wrong = wrong.unionByName(errors(flow.where("gone and (full or owner_kind is null or owner_kind <> kind)"), "no_owner"))
    whole = Window.partitionBy("doc_id", "chain")
    parts = flow.withColumn("merged", (F.count(F.lit(1)).over(whole) > 1) | F.bool_or("marked").over(whole)).where("merged and owner_kind is not null")

    key = ["doc_id", "page", "kind", "box"]
    known = originals.groupBy(*key).agg(F.collect_list(F.struct("index", "lines")).alias("known"))
    same = F.filter("known", lambda k: F.col("index").isNull() | k["index"].eqNullSafe(F.col("index")))
    parts = parts.join(known, key, "left").withColumn("own", F.when(F.size(same) == 1, F.get(same, 0)["lines"]))
    size = F.array("width", "height", "width", "height")
    scaled = F.when((F.col("width") > 0) & (F.col("height") > 0) & _measured(F.col("box")), F.zip_with("box", size, lambda v, s: F.floor(v * 1000 / s).cast("double")))
    said = items.groupBy("doc_id", "page", F.col("box").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item"), F.min("text").alias("text")).where("n = 1").drop("n")
    parts = parts.withColumn("at", scaled).join(said, ["doc_id", "page", "at"], "left")
    sound = _sound(F.col("own")) & ~_crossing(F.col("own"))
    part = F.struct("page", "ordinal", "lines", "own", "item", "text", sound.alias("sound"), _readings(F.to_json(F.when(sound, F.col("own")))).alias("read"), _readings(F.to_json(F.when(_sound(lines), lines))).alias("all"))
    chains = parts.groupBy("doc_id", "chain").agg(F.collect_list(part).alias("parts")).withColumn("parts", F.array_sort("parts", lambda x, y: F.when((x["page"] < y["page"]) | ((x["page"] == y["page"]) & (x["ordinal"] < y["ordinal"])), -1).otherwise(1)))

    p = F.col("parts")
    first = F.get(p, 0)
    ours = F.flatten(F.transform(p, lambda x: x["own"]))
    marks = F.transform(first["lines"], lambda x: F.transform(x["spans"], lambda s: F.coalesce(s["cross"], F.lit(False))))
    due = F.flatten(F.transform(p, lambda x: F.transform(x["own"], lambda o: F.transform(o["spans"], lambda s: x["page"] != first["page"]))))
    said = F.transform(p, lambda x: x["text"])
    taken = F.forall(F.slice(said, 2, F.size(p)), lambda t: t == "")
    reading = lambda k: F.transform(p, lambda x: F.get(x["read"], k))
    chosen = F.array_distinct(F.array_compact(F.array(*(F.when((said == reading(k)) | ((F.get(said, 0) == F.get(first["all"], k)) & taken), reading(k)) for k in (0, 1)))))
    why = (
        F.when(~F.forall(p, lambda x: x["sound"]) | ~_sound(first["lines"]), "no_original").when(F.exists(p, lambda x: x["item"].isNull()), "no_item")
        .when(~(_without_marks(first["lines"]) == _without_marks(ours)), "other_lines").when(~(marks == due), "other_marks")
        .when(F.size(chosen) != 1, "other_text")
    )
    done = chains.withColumns({"error": why, "texts": chosen})
    bad = wrong.unionByName(done.where("error is not null").select("doc_id", "error")).distinct()
    texts = done.where("error is null").select("doc_id", F.explode(F.arrays_zip(F.transform(p, lambda x: x["item"]).alias("item"), F.get("texts", 0).alias("text"))).alias("x"))
    good = texts.select("doc_id", "x.item", "x.text", F.lit(None).cast("string").alias("error")).join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
    return good.unionByName(bad.select("doc_id", F.lit(None).cast("long").alias("item"), F.lit(None).cast("string").alias("text"), "error"))


def page_status(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, page, stated and status of each page by its entries: parsed, empty, partial or unavailable.

    ``pages``: doc_id, page, size, expected, status; ``entries``: doc_id, page, status, source_ids. A page is whole if
    its size and count are known, as many entries are reported and none is unavailable; it is seen if one has anchors.
    """
    reported = F.count_if(F.col("status") != "excluded").alias("reported")
    seen, lost = F.bool_or(F.size("source_ids") > 0).alias("seen"), F.bool_or(F.col("status") == "unavailable").alias("lost")
    both = pages.withColumnRenamed("status", "stated").join(entries.groupBy("doc_id", "page").agg(reported, seen, lost), ["doc_id", "page"], "left").na.fill({"reported": 0, "seen": False, "lost": False})
    missing = F.col("size").isNull() | F.col("expected").isNull() | (F.col("reported") < F.col("expected")) | F.col("lost")
    status = F.when(missing, F.when(F.col("seen"), "partial").otherwise("unavailable")).otherwise(F.when(F.col("seen"), "parsed").otherwise("empty"))
    return both.select("doc_id", "page", "stated", status.alias("status"))


def bundle_errors(pages: DataFrame, entries: DataFrame, files: DataFrame, anchors: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, rule and subject of what is wrong with bundles of recognised pages.

    ``pages`` and ``entries`` as for ``page_status``, entries with ordinal and box; ``files``: doc_id, role, path, size,
    sha256, rendered and payload (null: no such file); ``anchors``: doc_id, id of the source's elements; ``images``:
    doc_id, src of the source's images.
    """
    rule = lambda df, name, subject: df.select("doc_id", F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject"))
    gaps = lambda df, c, start: df.groupBy("doc_id").agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_distinct(c).alias("d"), F.count(c).alias("n")).where((F.col("lo") != start) | (F.col("hi") != F.col("n") - 1 + start) | (F.col("d") != F.col("n")))
    count = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    owned = entries.select("doc_id", "ordinal", F.explode("source_ids").alias("id"))
    twice = owned.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    no_ids = F.size("source_ids") == 0
    rendered = files.where("role = 'resource' and rendered").select("doc_id", F.col("path").alias("src")).distinct()
    shown = images.select("doc_id", "src").distinct()
    given = F.col("payload").isNotNull()
    found = [
        rule(gaps(pages, "page", 1), "page_gap", "n"),
        rule(gaps(entries, "ordinal", 0), "entry_gap", "n"),
        rule(page_status(pages, entries).where("not (stated <=> status)"), "page_status", "page"),
        rule(entries.join(count, "doc_id", "left").where("last is null or page > last"), "page_of_entry", "ordinal"),
        rule(entries.where((F.get("box", 0) > F.get("box", 2)) | (F.get("box", 1) > F.get("box", 3))), "box", "ordinal"),
        rule(entries.where((F.col("status") == "excluded") & ~no_ids), "excluded_with_anchor", "ordinal"),
        rule(entries.where(F.col("status").isin("included", "plain_fallback") & no_ids), "included_without_anchor", "ordinal"),
        rule(twice, "anchor_again", "id"),
        rule(owned.select("doc_id", "id").distinct().join(anchors, ["doc_id", "id"], "left_anti"), "anchor_not_in_source", "id"),
        rule(anchors.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "id_again", "id"),
        rule(files.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path_again", "path"),
        rule(files.where(F.col("path").rlike(r"^/|(^|/)\.\.?(/|$)|\\|//|^$")), "unsafe_path", "path"),
        rule(files.where(~given), "file_missing", "path"),
        rule(files.where(given & ((F.octet_length("payload") != F.col("size")) | (F.sha2("payload", 256) != F.col("sha256")))), "file_differs", "path"),
        rule(shown.join(rendered, ["doc_id", "src"], "left_anti"), "image_not_bound", "src"),
        rule(rendered.join(shown, ["doc_id", "src"], "left_anti"), "image_not_shown", "src"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def note_errors(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, ordinal and rule of notes that aren't in order or whose anchor doesn't stand for their marker.

    ``notes``: doc_id, ordinal, note_id, source_id, marker, body, block_id, place (of a part of the block: 0 for a
    text, an item's or cell's number in reading order), start, end; ``targets``: doc_id, block_id, b_ordinal, place, text.
    """
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    again = lambda c: F.row_number().over(Window.partitionBy("doc_id", c).orderBy("ordinal")) > 1
    known = targets.groupBy("doc_id", "block_id").agg(F.first("b_ordinal").alias("b_ordinal"))
    parts = targets.select("doc_id", "block_id", "place", "text")
    n = notes.join(known, ["doc_id", "block_id"], "left").join(parts, ["doc_id", "block_id", "place"], "left")
    at = F.struct("b_ordinal", "place", "start", "end")
    n = n.withColumns({"nth": F.row_number().over(w) - 1, "id_again": again("note_id"), "before": F.lag(at).over(w)})
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = {
        "ordinal": F.col("ordinal") != F.col("nth"),
        "note_id": F.col("id_again") | blank("note_id"),
        "source_id": (F.col("source_id") != "") & (F.col("source_id") != F.col("note_id")),
        "marker": blank("marker"),
        "body": blank("body"),
        "owner": F.col("b_ordinal").isNull(),
        "part": F.col("b_ordinal").isNotNull() & F.col("text").isNull(),
        "anchor": F.col("text").isNotNull() & ~(inside & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("marker"))),
        "order": F.col("b_ordinal").isNotNull() & (at <= F.col("before")),
    }
    return n.select("doc_id", "ordinal", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))


#: Roles of headings.
HEADING_ROLES = ("classification", "abstract", "acknowledgements")


def view_errors(blocks: DataFrame, views: DataFrame, marks: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, block_id and rule of rich views that don't fit their plain blocks.

    ``blocks``: doc_id, block_id, kind, level, roles, height and width (of a table's grid); ``views``: doc_id, block_id,
    field, place, text and plain (null where the block has no such field, or the block's field no view); ``marks``:
    doc_id, block_id, field, place, start, end; ``cells``: doc_id, block_id, row, col, rows, cols.
    """
    roles, key = F.col("roles"), ["doc_id", "block_id"]
    level = F.col("level")
    semantic = F.when(F.array_contains(roles, "abstract"), level != 2).when(F.array_contains(roles, "acknowledgements"), ~level.between(2, 6))
    rules = {
        "unknown_role": F.exists(roles, lambda r: ~r.isin(*HEADING_ROLES)),
        "conflicting_roles": F.size(roles) > 1,
        "role_of_heading": (F.size(roles) > 0) & (F.col("kind") != "heading"),
        "level_of_role": (F.size(roles) == 1) & F.coalesce(semantic, F.lit(False)),
    }
    broken = blocks.select(*key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))
    rule = lambda df, name: df.select(*key, F.lit(name).alias("rule")).distinct()
    ranges = marks.join(views.select(*key, "field", "place", "text"), [*key, "field", "place"], "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    grid = cells.join(blocks.select(*key, "height", "width"), key, "left")
    fits = (F.least("row", "col") >= 0) & (F.least("rows", "cols") >= 1) & (F.col("row") + F.col("rows") <= F.col("height")) & (F.col("col") + F.col("cols") <= F.col("width"))
    fits = F.coalesce(fits, F.lit(False))
    # overlaps are looked for by points, of cells that lie within their grid
    table = F.struct(*key)
    over = grid_overlaps(grid.where(fits).select(table.alias("doc_id"), "row", "col", "rows", "cols")).select("doc_id.*")
    return (
        broken.unionByName(rule(views.where("not (text <=> plain)"), "text_of_view")).unionByName(rule(ranges.where(~F.coalesce(inside, F.lit(False))), "mark"))
        .unionByName(rule(grid.where(~fits), "cell")).unionByName(rule(over, "overlap"))
    )
