"""Words, rasters, fixtures and saved sessions as sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..functions.money import format_cents, strip
from . import adapters
from . import trees as plain_trees
from .trees import INSIDE

#: Layout of a printed receipt in pixels; fixed values.
LINE, LEFT, RIGHT, TOP, ADVANCE, TALL = 30, 45, 575, 60, 12.6, 15
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
FOUND = f"array<struct<text:string,bbox:{BOX},confidence:double>>"


def lines(spark: SparkSession, sf_dir: str, frames: int = 0) -> DataFrame:
    """receipt_id, line, label, price: what a receipt prints, from its merchant to its thanks; with frames, so many times, with the frame's number.

    A receipt is one row until its lines are opened, so the lines of one (and its words) stand together.
    """
    bills = adapters.bills(spark, sf_dir)
    items = adapters.items(spark, sf_dir, described=True)
    none = F.lit(None).cast("bigint")
    line = "struct<line:int,label:string,price:bigint>"

    def printed(line_no: Column, label: Column, price: Column = none) -> Column:
        return F.struct(line_no.alias("line"), label.alias("label"), price.alias("price")).cast(line)

    head = F.struct(F.col("n_items").cast("int").alias("n"), *adapters.FIELDS)
    body = printed(F.col("item_idx") + 2, F.col("desc"), F.col("price"))
    parts = bills.select("receipt_id", head.alias("head"), F.lit(None).cast(line).alias("body")).unionByName(items.select("receipt_id", body.alias("body")), allowMissingColumns=True)
    pages = parts.groupBy("receipt_id").agg(F.collect_list("head").alias("heads"), F.collect_list("body").alias("bodies"))

    def rest(h: Column) -> Column:
        return F.array(
            printed(F.lit(0), F.concat(F.lit("SHOP "), (F.col("receipt_id") % 97).cast("string"))),
            printed(F.lit(1), F.lit("----------")),
            printed(h["n"] + 2, F.lit("----------")),
            *(printed(h["n"] + 3 + k, F.lit(f.upper()), h[f]) for k, f in enumerate(adapters.FIELDS)),
            printed(h["n"] + 7, F.lit("THANK YOU")),
        )

    shown = F.concat(F.flatten(F.transform("heads", rest)), "bodies")
    if not frames:
        return pages.select("receipt_id", F.inline(shown))
    taken = pages.withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(frames))))
    return taken.select("receipt_id", "frame", F.inline(shown))


def render(lines: DataFrame, skew: Column | None = None, tall: float = TALL) -> DataFrame:
    """Words of printed lines, described from the left and priced at the right edge, on paper that may be askew."""
    slope = (F.col("receipt_id") % 7 - 3) * F.lit(0.01) if skew is None else skew
    own = [c for c in ("receipt_id", "frame") if c in lines.columns]
    shown = F.when(F.col("price").isNotNull(), F.concat("parts", F.array(format_cents("price")))).otherwise(F.col("parts"))
    each = lines.select(*own, "line", "label", "price", F.split("label", " ").alias("parts")).select(*own, "line", "label", F.size("parts").alias("n"), F.posexplode(shown).alias("k", "text"))
    # What stands before the word in its line, with the space behind it.
    before = F.length(F.call_function("substring_index", F.col("label"), F.lit(" "), F.col("k"))) + F.when(F.col("k") > 0, 1).otherwise(0)
    wide, amount = ADVANCE * F.length("text"), F.col("k") == F.col("n")
    x0 = F.when(amount, F.lit(float(RIGHT)) - wide).otherwise(F.lit(float(LEFT)) + ADVANCE * before)
    x1 = F.when(amount, F.lit(float(RIGHT))).otherwise(F.lit(float(LEFT)) + ADVANCE * before + wide)
    y = TOP + LINE * F.col("line") + slope * (x0 + x1) / 2
    return each.select(*own, (F.col("line") * 100 + F.col("k")).alias("word_idx"), "text", x0.alias("x0"), y.alias("y0"), x1.alias("x1"), (y + tall).alias("y1"), F.lit(90.0).alias("confidence"))


def words(spark: SparkSession, sf_dir: str, frames: int = 0) -> DataFrame:
    return render(lines(spark, sf_dir, frames))


def degraded(words: DataFrame, frames: int = 4) -> DataFrame:
    """Words as a few poor frames of each receipt would have them: amounts lose their decimal point or are lost, and the paper turns a little.

    receipt_id becomes ten times the receipt's own plus the number of the frame. Words that have a frame's number already
    are taken as they are, so what stands together stays so.
    """
    shaken = words if "frame" in words.columns else words.withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(frames))))
    luck = F.expr("(receipt_id * 31 + word_idx div 100 * 7 + frame * 13) % 17")
    amount = F.col("x1") == F.lit(float(RIGHT))
    kept = shaken.where(~(amount & (luck == 1)))
    turn = (F.col("frame") - 2) * F.lit(0.005) * (F.col("x0") + F.col("x1")) / 2
    text = F.when(amount & (luck == 0), F.replace("text", F.lit("."), F.lit(""))).otherwise(F.col("text"))
    return kept.select((F.col("receipt_id") * 10 + F.col("frame")).alias("receipt_id"), "word_idx", text.alias("text"), "x0", (F.col("y0") + turn).alias("y0"), "x1", (F.col("y1") + turn).alias("y1"), "confidence")


def word_lists(trees: DataFrame, column: str = "tree", key: str = "receipt_id") -> DataFrame:
    """key, readable, ws: all words in a recogniser's JSON of any layout and depth, in order; a row for every tree.

    A walk from the root: of an array each element, of an object its list `words` and nothing else, or, where it has
    none, what it keeps under INSIDE; anything else holds nothing. Words without text or box go; a confidence that isn't
    a number is 0. A tree that isn't JSON (or has a name twice in one object, or exceeds a VARIANT) is not readable and
    has no words. Plain trees are read in batches (sources.trees); the others as a VARIANT, by a walk in one array that is
    opened level by level in its place, for as long as it has open nodes.
    """
    node = lambda v, done: F.struct(v.alias("v"), F.lit(done).alias("word"))
    get = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))  # the value is worked out once

    def as_nodes(vs: Column, done: bool) -> Column:
        return F.transform(vs, lambda x: node(x, done))

    def inside(v: Column) -> Column:
        """What stands under INSIDE; a list is opened at once."""
        one = lambda k: bound(get(v, f"$.{k}", "array<variant>"), lambda e: F.coalesce(e, F.array_compact(F.array(get(v, f"$.{k}")))))
        return as_nodes(F.flatten(F.array(*(one(k) for k in INSIDE))), False)

    def opened(n: Column) -> Column:
        v = n["v"]
        listed = lambda ws: F.when(ws.isNotNull(), as_nodes(ws, True)).otherwise(inside(v))
        elements = lambda es: F.when(es.isNotNull(), as_nodes(es, False)).otherwise(bound(get(v, "$.words", "array<variant>"), listed))
        return F.when(n["word"], F.array(n)).otherwise(bound(get(v, "$", "array<variant>"), elements))

    def level(seen: Column, _: Column) -> Column:
        more = F.struct(F.flatten(F.transform(seen["nodes"], opened)).alias("nodes"), F.exists(seen["nodes"], lambda n: ~n["word"]).alias("open"))
        return F.when(seen["open"], more).otherwise(seen)

    root = F.struct(F.array(node(F.col("_root"), False)).alias("nodes"), F.lit(True).alias("open"))
    deepest = F.length(F.regexp_replace("left", r"[^\[{]", "")) + 2
    leaves = F.aggregate(F.sequence(F.lit(1), deepest), root, level)["nodes"]

    def parts(n: Column) -> Column:
        return get(n["v"], "$", "struct<text:variant,bbox:variant,confidence:variant>")

    def word(p: Column) -> Column:
        box, kind = get(p["bbox"], "$", BOX), F.schema_of_variant(p["confidence"])
        truthy = p["bbox"].isNotNull() & ~F.is_variant_null(p["bbox"]) & ~F.coalesce(F.to_json(p["bbox"]).isin("false", "0", '""'), F.lit(False))
        return F.struct(
            F.when(F.schema_of_variant(p["text"]) == "STRING", strip(get(p["text"], "$", "string"))).alias("text"),
            F.coalesce(box, F.when(truthy, F.struct(*(get(p["bbox"], f"$.{k}", "double").alias(k) for k in ("x0", "y0", "x1", "y1"))))).alias("bbox"),
            F.coalesce(F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), get(p["confidence"], "$", "double")), F.lit(0.0)).alias("confidence"),
        )

    kept = F.filter(F.transform(F.transform(leaves, parts), word), lambda w: F.coalesce(w["text"] != "", F.lit(False)) & w["bbox"].isNotNull())
    kind = trees.schema[key].dataType.simpleString()
    plain = trees.select(F.col(key).alias("key"), F.col(column).alias("tree")).mapInArrow(plain_trees.read, f"key {kind}, left string, whole boolean, found {FOUND}")
    read = fixed(plain, _root=F.try_parse_json("left"))
    found = F.when(F.col("whole"), F.col("found")).when(F.col("_root").isNotNull(), kept).otherwise(F.array().cast(FOUND))
    return fixed(read, ws=found).select(F.col("key").alias(key), (F.col("whole") | F.col("_root").isNotNull()).alias("readable"), "ws")


def flatten(trees: DataFrame, column: str = "tree", key: str = "receipt_id") -> DataFrame:
    """key, word_idx, text, box and confidence: the words of word_lists(), a row each; trees without words give none."""
    each = word_lists(trees, column, key).select(key, F.posexplode("ws").alias("word_idx", "w"))
    return each.select(key, "word_idx", "w.text", "w.bbox.x0", "w.bbox.y0", "w.bbox.x1", "w.bbox.y1", "w.confidence")


def to_tree(words: DataFrame, layout: Column | None = None) -> DataFrame:
    """receipt_id, tree: words as recognisers of several versions would give them; layout (0 to 7) says in which way."""
    by = F.col("receipt_id") % 8 if layout is None else layout
    word = F.struct(F.col("text"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), F.col("confidence"))
    page = words.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", F.to_json(word).alias("w")))).alias("ws"))
    page = page.select("receipt_id", F.col("ws.w").alias("ws"))
    half = F.floor(F.size("ws") / 2).cast("int")
    first, second = F.slice("ws", F.lit(1), half), F.slice("ws", half + 1, F.size("ws"))
    listed = lambda ws: F.concat(F.lit("["), F.array_join(ws, ","), F.lit("]"))
    having = lambda name, inner: F.concat(F.lit(f'{{"{name}":'), inner, F.lit("}"))
    each = lambda ws: listed(F.transform(ws, lambda w: F.concat(F.lit('{"words":['), w, F.lit("]}"))))
    one = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    deep = (F.col("receipt_id") % 50 + 1).cast("int")
    blank = '{"text":"  ","bbox":{"x0":1,"y0":1,"x1":2,"y1":2}},{"text":"no box"},{"text":7,"bbox":{"x0":1}},{"bbox":{"x0":1}},'
    layouts = [
        having("blocks", one(having("paragraphs", one(having("lines", each(F.col("ws"))))))),
        having("words", listed(F.col("ws"))),
        having("lines", each(F.col("ws"))),
        having("blocks", F.concat(F.lit("["), having("lines", each(first)), F.lit(","), having("paragraphs", having("words", listed(second))), F.lit("]"))),
        F.concat(F.repeat(F.lit('{"children":['), deep), having("words", listed(F.col("ws"))), F.repeat(F.lit("]}"), deep)),
        F.concat(F.lit("["), each(first), F.lit(",[[],[["), having("words", listed(second)), F.lit(']],null,5,"words"]]')),
        F.concat(F.lit('{"lines":'), each(second), F.lit(',"symbols":[{"words":[{"text":"never","bbox":{}}]}],"words":"none","blocks":'), each(first), F.lit("}")),
        F.concat(F.lit('{"lines":[{"words":[{"text":"never","bbox":{}}]}],"words":[' + blank), F.array_join("ws", ","), F.lit("]}")),
    ]
    return page.select("receipt_id", F.coalesce(*(F.when(by == k, x) for k, x in enumerate(layouts))).alias("tree"))


def width() -> Column:
    """How far to the right the boxes of a group of words reach."""
    return F.coalesce(F.max("x1"), F.lit(0.0))


def extent(words: DataFrame) -> DataFrame:
    """receipt_id, width, height: as far as boxes reach."""
    return words.groupBy("receipt_id").agg(width().alias("width"), F.coalesce(F.max("y1"), F.lit(0.0)).alias("height"))


def to_pgm(width: Column, height: Column, data: Column) -> Column:
    """A grey plane as a binary portable grey map."""
    return F.concat(F.encode(F.concat(F.lit("P5\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n255\n")), "UTF-8"), data)


def discover(truths: DataFrame, files: DataFrame) -> DataFrame:
    """stem, path: each truth's picture, by the order of kinds; truths without one have null."""
    rank = F.coalesce(*(F.when(F.col("ext") == e, F.lit(i)) for i, e in enumerate((".png", ".jpg", ".jpeg", ".webp"))))
    best = files.withColumn("_r", rank).where("_r is not null").groupBy("stem").agg(F.min_by("ext", "_r").alias("ext"))
    return truths.join(best, "stem", "left").select("stem", F.concat("stem", "ext").alias("path"))


def save(bills: DataFrame, version: int = 2) -> DataFrame:
    """v, state: bills as JSON with the version they are written in; pictures that live in memory only are left out."""
    own = [F.when(F.col(c).startswith("blob:"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "image" else F.col(c) for c in bills.columns]
    return bills.select(F.lit(version).alias("v"), F.to_json(F.struct(*own)).alias("state"))


def load(saved: DataFrame, schema: str, version: int = 2) -> DataFrame:
    """The bills of the current version; what can't be read is left out."""
    return saved.where(F.col("v") == version).select(F.from_json("state", schema).alias("b")).where("b is not null").select("b.*")


def gray(path_frame: DataFrame) -> DataFrame:
    """path, width, height, data of binary grey maps read with the binaryFile source."""
    text = F.decode(F.substring("content", 1, 40), "ISO-8859-1")
    head = F.regexp_extract(text, r"^P5\s(\d+)\s(\d+)\s255\s", 0)
    return path_frame.where(F.length(head) > 0).select("path", F.regexp_extract(text, r"^P5\s(\d+)", 1).cast("int").alias("width"), F.regexp_extract(text, r"^P5\s\d+\s(\d+)", 1).cast("int").alias("height"), F.expr("substring(content, length(regexp_extract(decode(substring(content, 1, 40), 'ISO-8859-1'), '^P5\\\\s\\\\d+\\\\s\\\\d+\\\\s255\\\\s', 0)) + 1)").alias("data"))

