"""What stands in for an occurrence: whole, partial, by component or by character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import intersects
from ..functions.text import match_form, once, strip, tokens
from ..session import settled
from .enrich import strategy_of

SEPARATORS = ("/", "-", r"\.", r"\s+")


def _words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def occurrence_replacement(entity_text: Column, replacement: Column, occurrence: Column) -> Column:
    """The part of the replacement that an occurrence of the entity, maybe partial, calls for.

    All of it for the whole text; the same slice for a slice of its words; for a
    shared end, the occurrence's own beginning with that end replaced; else all.
    """

    def of_words(w: Column) -> Column:
        e, o, r = (w[c] for c in ("e", "o", "r"))
        n, k = F.size(e), F.size(o)
        slots = F.when((k > 0) & (n >= k), F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        at = F.get(F.filter(slots, lambda i: F.slice(e, i, k) == o), 0)
        part = lambda at: F.when(at.isNotNull(), F.array_join(F.slice(r, at, F.greatest(k, F.lit(0))), " "))
        least = F.least(n, k)
        ends = F.when(least > 0, F.sequence(least, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        tail = F.get(F.filter(ends, lambda m: F.slice(e, n - m + 1, m) == F.slice(o, k - m + 1, m)), 0)
        mixed = lambda t: F.array_join(F.concat(F.slice(_words(occurrence), 1, F.greatest(k - t, F.lit(0))), F.slice(r, F.greatest(F.size(r) - t + 1, F.lit(1)), t)), " ")
        by_end = once(tail, lambda t: F.when(t.isNotNull() & (F.size(r) > 0), mixed(t)).otherwise(replacement))
        return once(once(at, part), lambda p: F.when(p != "", p).otherwise(by_end))

    # Texts are cut once each, and only where the occurrence is not the whole entity.
    words = F.struct(tokens(entity_text).alias("e"), tokens(occurrence).alias("o"), _words(replacement).alias("r"))
    return F.when(match_form(entity_text) == match_form(occurrence), replacement).otherwise(once(words, of_words))


def entity_replacement(entities: DataFrame) -> DataFrame:
    """Final replacement by strategy: nothing to black out, the preset text, else [TYPE]; the first of a text holds for all its like."""
    kind = strategy_of(F.col("strategy"))
    own = F.when(kind == "redact", "").when(F.coalesce("replacement_text", F.lit("")) != "", F.col("replacement_text")).otherwise(F.concat(F.lit("["), F.upper("entity_type"), F.lit("]")))
    w = Window.partitionBy("doc_id", F.lower(strip(F.col("original_text"))), kind).orderBy("ent_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return entities.withColumn("replacement", F.first(own).over(w))


def align_components(parts: DataFrame) -> DataFrame:
    """Replacement of form fields that hold components of a value.

    In: doc_id, occ_id, original, replacement, field_id, x0, y0, value. The
    original and its replacement are cut by the first separator (/ - . space)
    that gives both as many parts, two at least; a field holding a part takes the
    replacement's part, equal parts from left to right. Fields of one to three
    characters take characters by their offset in reading order if both sides
    have as many. Any other field takes the whole replacement.
    """
    split = lambda c, s: F.filter(F.split(c, s), lambda p: p != "")
    options = [F.when((F.size(split(F.col("original"), s)) == F.size(split(F.col("replacement"), s))) & (F.size(split(F.col("original"), s)) >= 2), F.struct(split(F.col("original"), s).alias("o"), split(F.col("replacement"), s).alias("r"))) for s in SEPARATORS]
    f = parts.withColumn("cut", F.coalesce(*options))
    f = f.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "occ_id", F.lower(strip(F.col("value")))).orderBy("x0", "field_id")))
    slots = F.filter(F.sequence(F.lit(0), F.size("cut.o") - 1), lambda i: F.lower(F.get("cut.o", i)) == F.lower(strip(F.col("value"))))
    whole = F.when(F.col("cut").isNotNull(), F.get("cut.r", F.coalesce(F.get(slots, F.least(F.col("nth"), F.size(slots)) - 1), F.lit(-1))))
    clear = lambda c: F.regexp_replace(c, r"[\s/.-]", "")
    before = Window.partitionBy("doc_id", "occ_id").orderBy(F.round("y0"), F.round("x0"), "field_id").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("offset", F.coalesce(F.sum(F.length(strip(F.col("value")))).over(before), F.lit(0)))
    size = F.length(strip(F.col("value")))
    by_char = F.when((size <= 3) & (F.length(clear(F.col("original"))) == F.length(clear(F.col("replacement")))), F.substr(clear(F.col("replacement")), (F.col("offset") + 1).cast("int"), size))
    exact = F.when(match_form(F.col("value")) == match_form(F.col("original")), F.col("replacement"))
    return f.withColumn("new_value", F.coalesce(exact, whole, F.nullif(by_char, F.lit("")), F.col("replacement"))).drop("cut", "nth", "offset")


def rewrite_field(value: Column, original: Column, replacement: Column, strategy: Column, component: Column) -> Column:
    """A field's new value: [MASKED] for redact, else the original replaced in it (any case), else its component; blank stays."""
    quoted = F.concat(F.lit(r"(?i)\Q"), F.replace(original, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    safe = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
    plain = F.replace(value, original, replacement)
    return (
        F.when(F.coalesce(strip(value), F.lit("")) == "", value)
        .when(strategy_of(strategy) == "redact", F.lit("[MASKED]"))
        .when(F.contains(value, original), plain)
        .when(F.contains(F.lower(value), F.lower(original)), F.regexp_replace(value, quoted, safe))
        .otherwise(component)
    )


#: Exponents of the cells that rectangles are put in, one in so many; smaller and larger ones take the last.
LEVELS, EVERY = (-20, 40), 2
GRAM = 3


def _level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The smallest of the exponents of two that gives cells no narrower than the rectangle."""
    side = F.greatest(x1 - x0, y1 - y0)
    return F.least(F.greatest(F.when(side > 0, F.ceil(F.log2(side) / EVERY) * EVERY), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def _in_cells(r: DataFrame, levels: list[int]) -> DataFrame:
    """Each rectangle in the cells it covers, four at most, of its own level and the larger ones."""
    r = r.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).withColumn("level", _level(*map(F.col, ("x0", "y0", "x1", "y1"))))
    r = r.withColumn("grid", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda g: g >= F.col("level"))))
    for v in "xy":
        r = r.withColumn(f"cell_{v}", F.explode(F.sequence(_cell(F.col(f"{v}0"), F.col("grid")), _cell(F.col(f"{v}1"), F.col("grid")))))
    return r


def touching_boxes(boxes: DataFrame, others: DataFrame, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Pairs (b, o) of rectangles x0, y0, x1, y1 of one page that intersect, as structs of all their columns.

    Rectangles meet in the cells of a grid: two of them at the level of the larger
    one, in the cell of the corner where their intersection begins and in no other, so a pair
    comes once and a crowded page costs what its neighbours are, not all its pairs.
    Rectangles with a null or with an end before its beginning touch nothing.
    """
    level = _level(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("level")
    # LEVELS bounds the rows.
    levels = sorted(r.level for r in boxes.select(level).union(others.select(level)).where("level is not null").distinct().collect())
    keyed = (*page, "x0", "y0", "x1", "y1")
    sides, packed = [], []
    for name, df in (("b", boxes), ("o", others)):
        # Rectangles that cover several cells are sent several times, so with no column twice.
        rest = [c for c in df.columns if c not in keyed]
        sides.append(_in_cells(df.select(*keyed, F.struct(*[F.col(f"`{c}`") for c in rest]).alias(name)) if rest else df.select(*keyed), levels).alias(f"side_{name}"))
        packed.append(F.struct(*[(F.col(f"side_{name}.{c}") if c in keyed else F.col(f"{name}.`{c}`")).alias(c) for c in df.columns]).alias(name))
    of = lambda side, c: F.col(f"side_{side}.{c}")
    key = [of("b", c) == of("o", c) for c in (*page, "grid", "cell_x", "cell_y")]
    first = [of("b", f"cell_{v}") == _cell(F.greatest(of("b", f"{v}0"), of("o", f"{v}0")), of("b", "grid")) for v in "xy"]
    meets = intersects(*[of(s, c) for s in "bo" for c in ("x0", "y0", "x1", "y1")])
    out = sides[0].join(sides[1], [*key, of("b", "grid") == F.greatest(of("b", "level"), of("o", "level")), *first, meets])
    return out.select(*packed)


def _held_in(inner: DataFrame, outer: DataFrame, page: tuple[str, ...]) -> DataFrame:
    """Pairs (inner, outer) of a page of which one text `form` holds the other: by the inner one's first characters."""
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("form") - n + 1, F.lit(1))), lambda i: F.substring(F.col("form"), i, n))))
    i = inner.withColumn("head", F.substring("form", 1, GRAM)).alias("i")
    o = outer.withColumn("head", F.explode(F.array_distinct(grams))).alias("u")
    same = [F.col(f"i.{c}") == F.col(f"u.{c}") for c in (*page, "head")]
    return i.join(o, [*same, F.contains(F.col("u.form"), F.col("i.form"))])


def fields_in_place(boxes: Column, fields: Column) -> Column:
    """The rows (occ_id, field_name, field_value, found_by) of fields_for_boxes for one page, whose boxes and fields are arrays; no row moves.

    All pairs of the page are looked at, so it is for pages of bounded size; crowded ones go through fields_for_boxes.
    """
    valid = lambda r: (r["x0"] <= r["x1"]) & (r["y0"] <= r["y1"])
    row = lambda b, f, by: F.struct(b["occ_id"].alias("occ_id"), f["field_name"].alias("field_name"), f["field_value"].alias("field_value"), F.lit(by).alias("found_by"))
    touch = lambda b, f: intersects(*[r[c] for r in (b, f) for c in ("x0", "y0", "x1", "y1")])
    touching = once(F.filter(fields, valid), lambda fs: F.flatten(F.transform(F.filter(boxes, valid), lambda b: F.transform(F.filter(fs, lambda f: touch(b, f)), lambda f: row(b, f, "box")))))
    box_form = lambda b: F.struct(b["occ_id"].alias("occ_id"), match_form(b["original"]).alias("form"))
    field_form = lambda f: F.struct(f["field_name"].alias("field_name"), f["field_value"].alias("field_value"), match_form(f["field_value"]).alias("form"))
    worded = lambda a: F.filter(a, lambda x: x["form"] != "")

    def with_rest(found: Column) -> Column:
        done = F.transform(found, lambda x: x["occ_id"])
        rest = once(done, lambda d: F.filter(boxes, lambda b: ~F.coalesce(F.array_contains(d, b["occ_id"]), F.lit(False))))
        held = lambda b, f: F.contains(f["form"], b["form"]) | F.contains(b["form"], f["form"])
        by_value = lambda bs: once(worded(F.transform(fields, field_form)), lambda fs: F.flatten(F.transform(bs, lambda b: F.transform(F.filter(fs, lambda f: held(b, f)), lambda f: row(b, f, "value")))))
        return once(worded(F.transform(rest, box_form)), lambda bs: F.when(F.size(bs) > 0, F.concat(found, by_value(bs))).otherwise(found))

    return once(touching, with_rest)


def fields_for_boxes(boxes: DataFrame, fields: DataFrame) -> DataFrame:
    """Form fields an occurrence's rectangle touches; where it touches none, fields whose value equals, holds or is part of it.

    boxes: doc_id, page_number, occ_id, original, x0, y0, x1, y1; fields: doc_id,
    page_number, field_name, field_value, x0, y0, x1, y1.
    """
    page = ("doc_id", "page_number")
    columns = ["doc_id", "page_number", "occ_id", "field_name", "field_value"]
    found = touching_boxes(boxes, fields)
    touching = found.select(*[F.col(f"{'o' if c.startswith('field') else 'b'}.{c}").alias(c) for c in columns], F.lit("box").alias("found_by"))
    touching = settled(touching, "touching")
    rest = boxes.join(touching.select(*page, "occ_id").distinct(), [*page, "occ_id"], "left_anti")
    b = rest.select(*page, "occ_id", match_form(F.col("original")).alias("form")).where("form <> ''")
    f = fields.select(*page, "field_name", "field_value", match_form(F.col("field_value")).alias("form")).where("form <> ''")
    holding = _held_in(b, f, page).select(*[F.col(f"{'u' if c.startswith('field') else 'i'}.{c}") for c in columns])
    # Equal texts hold each other and are among the first ones.
    part = _held_in(f, b, page).where("i.form <> u.form").select(*[F.col(f"{'i' if c.startswith('field') else 'u'}.{c}") for c in columns])
    return touching.unionByName(holding.unionByName(part).select(*columns, F.lit("value").alias("found_by")))
