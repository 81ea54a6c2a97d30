"""Text as column expressions: folding, phonetic keys, tokens, variants, parsing, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letter that each is folded to, position by position.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold(text: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def search_form(text: Column) -> Column:
    """Folded, with every run of other characters as one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """The words of a folded text."""
    return F.filter(F.split(search_form(text), " "), lambda w: w != "")


def order_free(text: Column) -> Column:
    """A name whose word order does not matter."""
    return F.array_join(F.sort_array(words(text)), " ")


def prefix_match(text: Column, query: Column) -> Column:
    """Whether every word of the query begins some word of the text."""
    return F.forall(words(query), lambda q: F.exists(words(text), lambda w: F.startswith(w, q)))


def whole_word(text: Column, word: Column) -> Column:
    return F.array_contains(words(text), word)


# What Spanish spelling writes in several ways, pattern and key, applied in this order; 1 stands for ch meanwhile.
SOUNDS = [
    ("[^a-z0-9]+", ""), ("ch", "1"), ("ll", "y"), ("qu", "k"), ("q", "k"), ("c([ei])", "s$1"), ("c", "k"), ("g([ei])", "j$1"),
    ("z", "s"), ("[vw]", "b"), ("h", ""), ("y", "i"), ("(.)\\1+", "$1"), ("1", "ch"),
]


def phonetic_key(text: Column) -> Column:
    """A key that words of the same sound share."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), SOUNDS, fold(text))


def deletions(word: Column) -> Column:
    """The word and all its forms with one letter left out."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.array_union(F.array(word), cut))


def error_budget(word: Column) -> Column:
    """Errors that a query word may have: none up to 3 letters, one up to 6, else two."""
    n = F.char_length(word)
    return F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2)


def similarity(written: Column, published: Column) -> Column:
    """How far a written word is a published one: 1 equal, 0.95 of one sound, 0.9 and 0.85 its beginning by letters and sound from four on, 0.8 and 0.65 with errors that its length allows, 0.5 an initial, else 0."""
    a, b = phonetic_key(written), phonetic_key(published)
    short, far = F.least(F.char_length(a), F.char_length(b)), F.levenshtein(a, b, 2)
    return (
        F.when(written == published, 1.0).when(F.char_length(written) == 1, F.when(F.startswith(published, written), 0.5).otherwise(0.0)).when(a == b, 0.95)
        .when((F.char_length(written) >= 4) & F.startswith(published, written), 0.9).when((F.char_length(a) >= 4) & F.startswith(b, a), 0.85)
        .when((far == 1) & (short >= 4), 0.8).when((far == 2) & (short >= 7), 0.65).otherwise(0.0)
    )


def unmangled(text: Column) -> Column:
    """A text whose UTF-8 was read as Latin-1, put right; texts that cannot have come about so stay."""
    odd = text.rlike("^[\\x00-\\xff]*$") & text.rlike("[\\xc2-\\xf4][\\x80-\\xbf]")
    back = F.encode(F.when(odd, text), "ISO-8859-1").cast("string")
    return F.when(odd & F.is_valid_utf8(back), back).otherwise(text)


def licence(text: Column) -> Column:
    """A licence without spaces and hyphens, in upper case."""
    return F.upper(F.regexp_replace(text, "[\\s-]+", ""))


def safe_cell(text: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike("^\\s*[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def round_of(label: Column) -> Column:
    """Competitors in the round that a label names: A64 or T64 64, QF 8, SF 4, F 2, else null."""
    n = F.regexp_extract(label, "^[ATat]([0-9]+)$", 1)
    return F.when(n != "", n.try_cast("int")).when(F.upper(label) == "QF", 8).when(F.upper(label) == "SF", 4).when(F.upper(label) == "F", 2)


def base_name(name: Column) -> Column:
    """A tournament's name without editions, years and age groups."""
    out = F.regexp_replace(search_form(name), "\\b((19|20)[0-9]{2}|[mu][0-9]{1,2}|[ivx]+|[0-9]+)\\b", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


# Words of an edition's name that tell its competitions apart and not the event: arms, genders, team or not, links.
ARM_WORDS = "epee espada fleuret florete foil saber sable sabre"
GENDER_WORDS = "dame fem femenina femenino homme masc masculina masculino men mixed mixta mixto women"
TEAM_WORDS = "equipe equipo individual individuel individuelle individuale team"
LINK_WORDS = "and d de del des du e el et la las los of par por s the y"
ALIKE = "championnat championship championat campeonato campionato campionat"


def edition_base(name: Column) -> Column:
    """What the names of one event's editions share: words without years, arms, genders, team and links.

    Age groups stay in one form (u15, sub 15, m-15 are m15); championships count as one
    championship; grand veterans and the bands of veterans' ages are veterans.
    """
    glued = F.regexp_replace(F.concat(F.lit(" "), search_form(name), F.lit(" ")), " (m|u|sub) ?([0-9]{1,2})(?= )", " m$2")
    tokens = F.filter(F.split(glued, " "), lambda w: w != "")
    old = F.exists(tokens, lambda w: w.isin("veteran", "veterans", "veterano", "veteranos"))
    plural = [w + "s" for words in (ARM_WORDS, GENDER_WORDS, TEAM_WORDS) for w in words.split()] + ["individuales"]
    dropped = " ".join([ARM_WORDS, GENDER_WORDS, TEAM_WORDS, LINK_WORDS]).split() + plural
    band = lambda w: old & (w.rlike("^[0-9]{2}$") | w.isin("grand", "grands"))
    kept = F.filter(tokens, lambda w: ~w.isin(dropped) & ~w.rlike("^(19|20)[0-9]{2}$") & ~band(w))
    one = F.transform(kept, lambda w: F.when(w.isin([a + "s" for a in ALIKE.split()]), F.rtrim(w, F.lit("s"))).otherwise(w))
    return F.array_join(one, " ")


# What a competition's name says about its type: phrase of the folded name, type, level; the first that is found counts.
TYPES = [("world cup", "WORLD_CUP", 2), ("championship", "CHAMPIONSHIP", 1), ("grand", "GRAND_PRIX", 2), ("satellite", "SATELLITE", 4), ("open", "OPEN", 5), ("cup", "CUP", 5)]


def competition_type(name: Column) -> Column:
    out = F.lit("OTHER")
    for phrase, kind, _ in reversed(TYPES):
        out = F.when(F.contains(search_form(name), F.lit(phrase)), kind).otherwise(out)
    return out
