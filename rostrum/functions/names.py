"""How two written names of people are related, as column expressions over their folded words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions.text import fold

# From the most compatible relation to the least, and what each allows when people are united.
LEVELS = {"same": "free", "clipped": "free", "compound": "free", "variant": "hint", "crossed": "evidence", "cousins": "never", "siblings": "never", "different": "never"}


def _differences(a: Column, b: Column) -> Column:
    """The places in which two lists of one size differ, as pairs."""
    return F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))


def _clipped(a: Column, b: Column) -> Column:
    """Whether a is b with its last words left out or with words cut after two letters or more."""
    cut = F.forall(F.arrays_zip(a.alias("a"), F.slice(b, 1, F.greatest(F.size(a), F.lit(1))).alias("b")), lambda p: (p["a"] == p["b"]) | ((F.char_length(p["a"]) >= 2) & F.startswith(p["b"], p["a"])))
    return (F.size(a) > 0) & (F.size(a) <= F.size(b)) & cut


def _mistyped(a: Column, b: Column) -> Column:
    """Whether one word alone differs, of five letters or more on both sides, by one error."""
    d = _differences(a, b)
    one = F.exists(d, lambda p: (F.least(F.char_length(p["a"]), F.char_length(p["b"])) >= 5) & (F.levenshtein(p["a"], p["b"]) == 1))
    return (F.size(a) == F.size(b)) & (F.size(d) == 1) & one


def relation(surnames: Column, given: Column, other_surnames: Column, other_given: Column) -> Column:
    """The relation of two names, null where a list is null.

    same; clipped: words left out or cut; compound: of several given names one side has
    fewer; variant: one typing error and all else equal; crossed: the surnames in
    another order; cousins: one name and first surname, another second one; siblings:
    the surnames, and given names that have nothing in common; else different.
    """
    s, g, t, h = surnames, given, other_surnames, other_given
    both = (F.size(g) > 0) & (F.size(h) > 0)
    within = both & (F.size(g) != F.size(h)) & ((F.size(F.array_except(g, h)) == 0) | (F.size(F.array_except(h, g)) == 0))
    surname, name = (s == t) | _clipped(s, t) | _clipped(t, s), (g == h) | _clipped(g, h) | _clipped(h, g)
    apart = both & F.forall(g, lambda w: F.forall(h, lambda v: ~F.startswith(w, v) & ~F.startswith(v, w) & (F.levenshtein(w, v) > 1)))
    cousins = (F.size(s) > 1) & (F.size(t) > 1) & (F.try_element_at(s, F.lit(1)) == F.try_element_at(t, F.lit(1))) & (g == h)
    any_null = s.isNull() | g.isNull() | t.isNull() | h.isNull()
    return (
        F.when(any_null, F.lit(None)).when((s == t) & (g == h), "same").when((s == t) & within, "compound").when(surname & name, "clipped")
        .when(((s == t) & _mistyped(g, h)) | ((g == h) & _mistyped(s, t)), "variant")
        .when((F.size(s) > 1) & (F.sort_array(s) == F.sort_array(t)) & (name | within), "crossed")
        .when(cousins, "cousins").when((s == t) & (F.size(s) > 0) & apart, "siblings").otherwise("different")
    )


def union_level(related: Column) -> Column:
    """Whether a relation unites people freely, as a hint, with further evidence, or never."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), related)


# Words that belong to the surname after them.
PARTICLES = ("da", "de", "del", "della", "der", "di", "do", "dos", "du", "el", "la", "las", "le", "los", "mac", "san", "santa", "van", "von", "y")
#: The most surnames that a name without marks is split into.
MOST_SURNAMES = 3
ORDERS = ("surnames_first", "given_first")


def units(words: Column) -> Column:
    """Words with the particles before them in one: ['de', 'la', 'cruz', 'ana'] are 'de la cruz' and 'ana'; particles that end a name stand for themselves."""
    def step(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        open_ended = F.coalesce(F.substring_index(last, " ", -1).isin(*PARTICLES), F.lit(False))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, w)))
        return F.when(open_ended, joined).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(words, F.expr("cast(array() as array<string>)"), step)


def written(name: Column) -> Column:
    """struct(units, capitals, marked, titled) of a name as it was written.

    A name is marked where some of its words, but not all, are in capitals: those are
    its surnames. It is titled where none is. Hyphens and apostrophes part words.
    """
    raw = F.filter(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), "[\\s'’.,-]+", " "), " "), lambda w: w != "")
    capital = lambda w: (F.char_length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)
    small = F.exists(raw, lambda w: F.upper(w) != w)
    some = F.exists(raw, capital)
    fold_all = lambda ws: units(F.transform(ws, fold))
    return F.struct(fold_all(raw).alias("units"), fold_all(F.filter(raw, capital)).alias("capitals"), fold_all(F.filter(raw, lambda w: ~capital(w))).alias("others"), (small & some).alias("marked"), (small & ~some).alias("titled"))


def _split(surnames: Column, given: Column) -> Column:
    return F.struct(surnames.alias("s"), given.alias("g"))


def splits(name: Column, order: Column) -> Column:
    """All splits of written() into struct(s, g), surnames and given names: the marked one alone, else those of the order; a null order means both."""
    u = name["units"]
    n = F.size(u)
    upto = lambda most: F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: k <= most)
    first = F.transform(upto(F.least(n - 1, F.lit(MOST_SURNAMES))), lambda k: _split(F.slice(u, F.lit(1), k), F.slice(u, k + 1, n)))
    last = F.transform(upto(F.least(n - 1, F.lit(MOST_SURNAMES))), lambda k: _split(F.slice(u, n - k + 1, k), F.slice(u, F.lit(1), n - k)))
    none = F.slice(first, 1, 0)
    order = F.when(name["titled"], F.lit(ORDERS[1])).otherwise(order)
    every = F.concat(F.when(order.eqNullSafe(ORDERS[1]), none).otherwise(first), F.when(order.eqNullSafe(ORDERS[0]), none).otherwise(last))
    alone = F.array(_split(u, F.slice(u, 1, 0)))
    return F.when(name["marked"], F.array(_split(name["capitals"], name["others"]))).when(n < 2, alone).otherwise(every)


def written_relation(one: Column, other: Column, order: Column, other_order: Column) -> Column:
    """The most compatible relation of two names as they were written, over all splits into surnames and given names.

    Where one side marks its surnames, the other is split so that no surname of it is a
    given name there, nor the other way round; in the other order if its own has no such
    split, and in its own if neither has. Without marks, the same words in a turned order
    of three or more are one name, and of two, crossed surnames unless the orders differ.
    """
    a, b = written(one), written(other)
    levels = F.array(*map(F.lit, LEVELS))

    def fitting(name: Column, order: Column, marked: Column) -> Column:
        s, g = marked["capitals"], marked["others"]

        def apart(x: Column) -> Column:
            return (F.size(F.array_except(F.array_intersect(x["g"], s), g)) == 0) & (F.size(F.array_except(F.array_intersect(x["s"], g), s)) == 0)

        own = splits(name, order)
        turned = splits(name, F.when(order == ORDERS[0], ORDERS[1]).when(order == ORDERS[1], ORDERS[0]))
        fits, else_fits = F.filter(own, apart), F.filter(turned, apart)
        return F.when(F.size(fits) > 0, fits).when(order.isNotNull() & (F.size(else_fits) > 0), else_fits).otherwise(own)

    mine = F.when(b["marked"] & ~a["marked"], fitting(a, order, b)).otherwise(splits(a, order))
    its = F.when(a["marked"] & ~b["marked"], fitting(b, other_order, a)).otherwise(splits(b, other_order))
    pairs = F.flatten(F.transform(mine, lambda x: F.transform(its, lambda y: F.array_position(levels, relation(x["s"], x["g"], y["s"], y["g"])))))
    best = F.get(levels, (F.array_min(pairs) - 1).cast("int"))
    n, u, v = F.size(a["units"]), a["units"], b["units"]
    plain = ~a["marked"] & ~b["marked"] & (F.sort_array(u) == F.sort_array(v))
    turn = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.slice(u, k, n), F.slice(u, F.lit(1), k - 1)) == v)
    alike = (n <= 2) & (order.isNull() | other_order.isNull() | (order == other_order))
    return (
        F.when(one.isNull() | other.isNull(), F.lit(None)).when((n == 0) | (F.size(v) == 0), "different").when(u == v, "same")
        .when(plain & alike, "crossed").when(plain & (n >= 3) & turn, "same").otherwise(F.coalesce(best, F.lit("different")))
    )
