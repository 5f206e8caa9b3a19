"""Documents with planted lines about invented people, so that detectors of names, addresses and birth dates can be taught and measured.

Each document gets four lines at a place of its own: one with a name, one with an
address, one with a date of birth, and one with a date or a company that is none of
these. Half of the names' words are capitalised words of the document itself, so
they stand in no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pseudonyms import FAMILY, GIVEN, STATES, STREETS, SUBURBS, draw, pick
from ..functions.text import once

# What stands before and behind a planted text.
NAMES = (("Patient: ", ""), ("Name: ", ""), ("Dear ", ","), ("Reviewed by Dr ", " on the ward."), ("This letter concerns ", ", who was seen today."), ("Mrs ", " was admitted after a fall."), ("Signed, ", ""), ("I spoke with ", " about the result."), ("The claimant ", " lives alone."), ("Thanks to ", " for the referral."))
ADDRESSES = (("Address: ", ""), ("He lives at ", "."), ("Please send the report to ", "."), ("Resides at ", " with family."), ("Home address ", ""), ("She moved to ", " last year."), ("Deliver to ", ", by hand."))
BIRTHS = (("DOB: ", ""), ("Date of birth ", ""), ("The child was born on ", "."), ("D.O.B. ", ", aged care."), ("Born ", " in hospital."), ("Birth date: ", ""))
OTHERS = (("Invoice dated ", "."), ("The meeting of ", " was moved."), ("Due ", " at the latest."), ("Printed ", ""))
#: Kinds of the first three lines.
_KINDS = ("Full Name", "Physical Address", "Date of Birth")
FIRMS = (("The offer of ", " Partners was declined."), ("Paid to ", " Holdings"))


def _line(salt: str, key: Column, tag: str, frames, value: Column) -> Column:
    """(text, start, length) of one line: a frame by hash around the value."""
    at = (draw(salt, key, tag, len(frames)) + 1).cast("int")
    frame = F.element_at(F.array(*[F.array(F.lit(b), F.lit(e)) for b, e in frames]), at)
    return once(frame, lambda f: once(value, lambda v: F.struct(F.concat(F.get(f, 0), v, F.get(f, 1)).alias("text"), F.length(F.get(f, 0)).alias("start"), F.length(v).alias("length"))))


def with_people(documents: DataFrame, salt: str = "people") -> DataFrame:
    """(doc_id, text, planted): texts with four more lines, and the spans (entity_type, original_text, start, length) in them."""
    key = F.col("doc_id").cast("string")
    h = lambda tag, n: draw(salt, key, tag, n)
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.concat(F.filter(F.split(F.col("text"), "[^A-Za-z]+"), lambda w: F.length(w).between(3, 9)), F.array(F.lit("Kim")))
    tags = ("g", "f", "s", "x", "z")
    # Cutting a text is the dear step, so the document's own words are drawn from it in one go.
    own = once(words, lambda w: F.array(*[F.initcap(F.element_at(w, (h(tag + "w", 1 << 30) % F.size(w) + 1).cast("int"))) for tag in tags]))
    given = sum(GIVEN.values(), ())

    def lines(mine: Column) -> Column:
        def word(tag: str, pool) -> Column:
            return F.when(h(tag, 2) == 0, pick(salt, key, tag + "p", pool)).otherwise(F.get(mine, tags.index(tag)))

        middle = F.when(h("m", 4) == 0, F.concat(F.char((h("mi", 26) + 65).cast("int")), F.lit(" "))).otherwise("")
        name = F.concat(word("g", given), F.lit(" "), middle, word("f", FAMILY))
        unit = F.when(h("u", 4) == 0, F.concat(F.lit("Unit "), (h("un", 40) + 1).cast("string"), F.lit(", "))).otherwise("")
        street = F.concat(unit, (h("n", 300) + 1).cast("string"), F.lit(" "), word("s", STREETS), F.lit(" "), pick(salt, key, "k", ("Street", "Road", "Ave", "Cres", "Tce", "Lane")))
        place = F.concat(pick(salt, key, "c", SUBURBS), F.lit(" "), pick(salt, key, "t", STATES), F.lit(" "), (h("p", 7000) + 2000).cast("string"))
        address = F.concat(street, F.lit(", "), place)

        def date(tag: str, first: int, years: int) -> Column:
            day = F.make_date((h(tag + "y", years) + first).cast("int"), (h(tag + "m", 12) + 1).cast("int"), (h(tag + "d", 28) + 1).cast("int"))
            return F.when(h(tag, 3) == 0, F.date_format(day, "dd/MM/yyyy")).when(h(tag, 3) == 1, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))

        other = F.when(h("o", 3) == 0, _line(salt, key, "of", FIRMS, F.concat(word("x", FAMILY), F.lit(" "), word("z", FAMILY)))).otherwise(_line(salt, key, "od", OTHERS, date("q", 1930, 95)))
        return F.array(_line(salt, key, "fn", NAMES, name), _line(salt, key, "fa", ADDRESSES, address), _line(salt, key, "fb", BIRTHS, date("b", 1930, 95)), other)

    def made(lines: Column) -> Column:
        return once(F.split("text", "\n"), lambda every: once((h("at", 1 << 30) % (F.size(every) + 1)).cast("int"), lambda at: placed(lines, every, at)))

    def placed(lines: Column, every: Column, at: Column) -> Column:
        head = F.array_join(F.slice(every, 1, at), "\n")
        behind = F.array_join(F.slice(every, at + 1, F.size(every)), "\n")
        planted = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
        tail = F.when(at < F.size(every), F.concat(F.lit("\n"), behind)).otherwise("")
        before = F.when(at > 0, F.concat(head, F.lit("\n"))).otherwise("")
        return once(before, lambda b: F.struct(F.concat(b, planted, tail).alias("text"), F.array(*[span(lines, b, i) for i in range(3)]).alias("planted")))

    def span(lines: Column, before: Column, i: int) -> Column:
        line = F.get(lines, i)
        start = sum((F.length(F.get(lines, k)["text"]) + 1 for k in range(i)), F.length(before)) + line["start"]
        value = F.substring(line["text"], line["start"] + 1, line["length"])
        return F.struct(F.lit(_KINDS[i]).alias("entity_type"), value.alias("original_text"), start.alias("start"), line["length"].alias("length"))

    d = d.select("doc_id", once(once(own, lines), made).alias("_made"))
    return d.select("doc_id", "_made.text", "_made.planted")


def held_out(salt: str = "people") -> Column:
    """Documents that teach nothing: one in three by hash."""
    return draw(salt, F.col("doc_id").cast("string"), "split", 3) == 0
