"""Replacements that never collide: keyed permutations of the numbers below a * b.

A number is a pair (left below a, right below b); each of ROUNDS rounds adds a keyed
hash of the right half to the left one, modulo a, and then of the left half to the
right one, modulo b. Every step can be undone, so the whole is a permutation for
every salt and scope, without a table: distinct numbers stay distinct on any task.
Domains are given as products, so no number ever falls outside and has to be walked
back. Who holds the salt can undo it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pseudonyms import FAMILY, GIVEN, STREETS, SUBURBS

ROUNDS = 4
#: Digits that are permuted together; longer numbers go by blocks.
BLOCK = 18

NAMES = sum(GIVEN.values(), ())
HOUSES = 200


def _hash(salt: str, scope: Column, step: int, value: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat(F.lit(f"{salt}|"), scope.cast("string"), F.lit(f"|{step}|"), value.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def permute(salt: str, scope: Column, value: Column, a, b) -> Column:
    """The image of value, 0 <= value < a * b; a and b are numbers or columns."""
    a, b = _number(a), _number(b)
    pair = F.struct(_div(value, b).alias("l"), F.pmod(value, b).alias("r"))
    for i in range(ROUNDS):
        pair = _turn(pair, lambda p, i=i: (F.pmod(p["l"] + F.pmod(_hash(salt, scope, 2 * i, p["r"]), a), a), p["r"]))
        pair = _turn(pair, lambda p, i=i: (p["l"], F.pmod(p["r"] + F.pmod(_hash(salt, scope, 2 * i + 1, p["l"]), b), b)))
    return _turn(pair, lambda p: (p["l"] * b + p["r"], F.lit(0).cast("long")))["l"]


def unpermute(salt: str, scope: Column, image: Column, a, b) -> Column:
    """The number whose image this is."""
    a, b = _number(a), _number(b)
    pair = F.struct(_div(image, b).alias("l"), F.pmod(image, b).alias("r"))
    for i in reversed(range(ROUNDS)):
        pair = _turn(pair, lambda p, i=i: (p["l"], F.pmod(p["r"] - F.pmod(_hash(salt, scope, 2 * i + 1, p["l"]), b), b)))
        pair = _turn(pair, lambda p, i=i: (F.pmod(p["l"] - F.pmod(_hash(salt, scope, 2 * i, p["r"]), a), a), p["r"]))
    return _turn(pair, lambda p: (p["l"] * b + p["r"], F.lit(0).cast("long")))["l"]


def _div(value: Column, by: Column) -> Column:
    return F.call_function("div", value.cast("long"), by)


def _turn(pair: Column, f) -> Column:
    """f of a pair that is computed once: a list of one, so that rounds don't repeat what is before them."""
    return F.get(F.transform(F.array(pair), lambda p: F.struct(f(p)[0].alias("l"), f(p)[1].alias("r"))), 0)


def permuted_digits(salt: str, scope: Column, original: Column) -> Column:
    """original with its digits replaced by those of the permuted number; all else stays, and texts that differ stay different."""
    found = F.regexp_replace(original, "[^0-9]", "")
    n = F.length(found)

    def block(i):
        digits = F.substr(found, i * BLOCK + 1, F.lit(BLOCK))
        size = F.length(digits)
        half = _div(size, F.lit(2).cast("long"))
        ten = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
        image = permute(salt, F.concat(scope.cast("string"), F.lit("|"), i.cast("string"), F.lit("|"), size.cast("string")), digits.cast("long"), ten(half), ten(size - half))
        return F.lpad(image.cast("string"), size, "0")

    new = F.split(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block), ""), "")
    between = F.split(original, "[0-9]", -1)
    whole = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(new, i), F.lit("")))), "")
    return F.when(n > 0, whole).otherwise(original)


def _from(pool: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (i + 1).cast("int"))


def nth_name(salt: str, scope: Column, n: Column) -> Column:
    """The n-th name of a scope, from 0 on; names of later rounds through the pools have initials."""
    size = len(NAMES) * len(FAMILY)
    i, turn = permute(salt, scope, F.pmod(n, F.lit(size)), len(NAMES), len(FAMILY)), _div(n, F.lit(size).cast("long"))
    return F.concat(_from(NAMES, _div(i, F.lit(len(FAMILY)).cast("long"))), F.lit(" "), _initials(turn), _from(FAMILY, F.pmod(i, F.lit(len(FAMILY)))))


def _initials(turn: Column) -> Column:
    """Nothing, A., B., .., Z., A.A., ..: a number in letters."""
    letters = F.regexp_replace(F.translate(F.conv(turn.cast("string"), 10, 26), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "(.)", "$1.")
    return F.when(turn > 0, F.concat(letters, F.lit(" "))).otherwise("")


def nth_address(salt: str, scope: Column, n: Column) -> Column:
    """The n-th address of a scope; later rounds through the domain are units."""
    b = len(STREETS) * len(SUBURBS)
    size = HOUSES * b
    i, turn = permute(salt, scope, F.pmod(n, F.lit(size)), HOUSES, b), _div(n, F.lit(size).cast("long"))
    rest = F.pmod(i, F.lit(b))
    unit = F.when(turn > 0, F.concat(F.lit("Unit "), turn.cast("string"), F.lit(", "))).otherwise("")
    return F.concat(unit, (_div(i, F.lit(b).cast("long")) + 1).cast("string"), F.lit(" "), _from(STREETS, _div(rest, F.lit(len(SUBURBS)).cast("long"))), F.lit(" Street, "), _from(SUBURBS, F.pmod(rest, F.lit(len(SUBURBS)))))


def nth_email(salt: str, scope: Column, n: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(nth_name(salt, scope, n), "[. ]+", ".")), F.lit("@example.com"))


def distinct_fake(salt: str, scope: Column, entity_type: Column, original: Column, n: Column) -> Column:
    """A replacement that no other text of the scope and kind has: names, addresses and mail by their number n in the scope,
    texts with digits by the permuted number, others numbered."""
    t = F.lower(entity_type)
    kind = lambda *words: t.rlike("|".join(words))
    return (
        F.when(kind("name"), nth_name(salt, scope, n))
        .when(kind("email", "e-mail"), nth_email(salt, scope, n))
        .when(kind("address"), nth_address(salt, scope, n))
        .when(original.rlike("[0-9]"), permuted_digits(salt, F.concat(scope.cast("string"), F.lit("|"), t), original))
        .otherwise(F.concat(entity_type, F.lit(" "), (n + 1).cast("string")))
    )
