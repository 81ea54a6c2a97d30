"""What the title of a published document says: number, season, marks of its version, subject, read from its tokens, as column expressions.

Tokens are words with the digits that end them, numbers, and the signs - / ( ) between.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions.text import fold

TOKEN = "[A-Z]+[0-9]*|[0-9]+|[-/()]"
# Words that mark a version; a star stands for any ending.
MARKS = {"bis": "BIS", "updated": "ACTUALIZADA* ACTUALIZADO*", "complete": "COMPLETA", "amended": "MODIFICACION", "corrected": "SUBSANACION", "cancelled": "CANCELACION", "signed": "SIGNED"}
# Further words that are no part of a subject: months, a mark of no version, words without meaning of their own.
MONTHS = "ENERO FEBRERO MARZO ABRIL MAYO JUNIO JULIO AGOSTO SEPT SEPTIEMBRE OCTUBRE NOVIEMBRE DICIEMBRE"
OTHER = "CLARIFICACION"
STOP = "A DE DEL EL EN LA LAS LOS PARA POR Y"
# Forms of one word.
FORMS = {"CAMPEONATO": "CAMPEONATOS CTO", "COMPETICION": "COMPETICIONES", "EQUIPOS": "EQUIPO", "NACIONAL": "NACIONALES", "NORMATIVA": "NORMATIVAS", "RANKING": "RANKINGS"}


def title_tokens(title: Column) -> Column:
    """The tokens of a title in upper case without accents, its file ending left off."""
    plain = F.regexp_replace(F.upper(fold(title)), r"\.(PDF|DOCX?|XLSX?)$", "")
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


def _digits(t: Column, least: int, most: int) -> Column:
    """Whether a token is a number of so many digits; a missing one is not."""
    return F.coalesce(t.rlike("^[0-9]+$") & F.char_length(t).between(least, most), F.lit(False))


def _sign(t: Column) -> Column:
    return F.coalesce(t.isin("-", "/"), F.lit(False))


def _marked(t: Column, words: str) -> Column:
    """Whether a token is one of the words."""
    out = F.lit(False)
    for w in words.split():
        out = out | (F.startswith(t, F.lit(w[:-1])) if w.endswith("*") else t == w)
    return F.coalesce(out, F.lit(False))


def _first(tokens: Column, fits) -> Column:
    """The place of the first token for which fits(token, place) holds, null without one."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens), F.lit(1)) - 1), lambda i: fits(F.get(tokens, i), i))
    return F.get(places, 0)


def circular_number(tokens: Column) -> Column:
    """'n-yy' without leading zeros: a number of up to three digits and one of two, with or without a hyphen, after CIRCULAR; null for titles that have none."""
    after = lambda i, k: F.get(tokens, i + k)
    hyphen = lambda i: F.when(after(i, 2) == "-", 3).otherwise(2)
    at = _first(tokens, lambda t, i: (t == "CIRCULAR") & _digits(after(i, 1), 1, 3) & _digits(after(i, hyphen(i)), 2, 2))
    return F.when(at.isNotNull(), F.concat(after(at, 1).cast("int").cast("string"), F.lit("-"), F.get(tokens, at + hyphen(at))))


def title_season(tokens: Column) -> Column:
    """'YYYY-YYYY': two years in full, else the last pair of two digits that is no part of a date, else the two numbers that end the title; of two digits, only years that follow each other."""
    t = lambda i: F.get(tokens, i)
    full = _first(tokens, lambda x, i: _digits(x, 4, 4) & _sign(t(i + 1)) & _digits(t(i + 2), 4, 4))
    before = lambda i: F.when(i > 0, t(F.greatest(i - 1, F.lit(0))))
    dated = lambda i: (_sign(t(i + 3)) & _digits(t(i + 4), 1, 99)) | (_sign(before(i)) & _digits(before(i - 1), 2, 2))
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens), F.lit(1)) - 1), lambda i: _digits(t(i), 2, 2) & _sign(t(i + 1)) & _digits(t(i + 2), 2, 2) & ~dated(i))
    last = F.try_element_at(pairs, F.lit(-1))
    end = F.size(tokens) - 1
    following = lambda a, b: F.when(_digits(a, 2, 2) & _digits(b, 2, 2) & (F.when(_digits(b, 2, 2), b).cast("int") == F.when(_digits(a, 2, 2), a).cast("int") + 1), F.concat(F.lit("20"), a, F.lit("-20"), b))
    closing = F.when(end >= 1, following(t(F.greatest(end - 1, F.lit(0))), t(F.greatest(end, F.lit(0)))))
    return F.coalesce(F.when(full.isNotNull(), F.concat_ws("-", t(full), t(full + 2))), following(t(last), t(last + 2)), closing)


def title_marks(tokens: Column) -> dict[str, Column]:
    """version and sequence as numbers or null, every other mark as a boolean."""
    version = _first(tokens, lambda x, i: x.rlike("^V[0-9]{1,2}$"))
    sequence = _first(tokens, lambda x, i: _digits(x, 4, 4) & (F.get(tokens, i + 1) == "-") & F.get(tokens, i + 2).rlike("^[2-9]$"))
    numbers = {"version": F.substring(F.get(tokens, version), 2, 2).cast("int"), "sequence": F.get(tokens, sequence + 2).cast("int")}
    end = lambda k: F.try_element_at(tokens, F.lit(-k))
    copy = F.coalesce((end(1) == ")") & _digits(end(2), 1, 99) & (end(3) == "("), F.lit(False))
    has = lambda words: F.exists(tokens, lambda x: _marked(x, words))
    return numbers | {name: has(words) for name, words in MARKS.items()} | {"copy": F.when(tokens.isNotNull(), copy)}


def subject(tokens: Column) -> Column:
    """What the document is about: two files with one subject are versions of one document."""
    t = lambda i: F.get(tokens, i)
    apart = " ".join([*MARKS.values(), OTHER, MONTHS, STOP])
    bis = lambda i: F.coalesce((t(i + 1) == "BIS") | ((t(i + 1) == "-") & (t(i + 2) == "BIS")), F.lit(False))
    head = lambda x, i: (t(F.lit(0)) == "CIRCULAR") & ((i == 0) | ((i == 1) & _digits(x, 1, 3) & _digits(F.when(t(F.lit(2)) == "-", t(F.lit(3))).otherwise(t(F.lit(2))), 2, 2)))
    enclosed = lambda x, i: _digits(x, 1, 99) & (t(i + 1) == ")") & (F.when(i > 0, t(F.greatest(i - 1, F.lit(0)))) == "(")
    long_season = lambda x, i: _digits(x, 4, 4) & ((_sign(t(i + 1)) & _digits(t(i + 2), 4, 4)) | (_sign(F.when(i > 1, t(F.greatest(i - 1, F.lit(0))))) & _digits(F.when(i > 1, t(F.greatest(i - 2, F.lit(0)))), 4, 4)))
    gone = lambda x, i: F.coalesce(
        ~x.rlike("[A-Z0-9]") | head(x, i) | _marked(x, apart) | x.rlike("^V[0-9]{1,2}$") | _digits(x, 1, 2) | x.rlike("^(19|20)[0-9]{2}$") | long_season(x, i) | (bis(i) & _digits(x, 1, 99)) | enclosed(x, i), F.lit(False)
    )
    bare = F.transform(tokens, lambda x, i: F.when(gone(x, i), "").when(bis(i), F.rtrim(x, F.lit("0123456789"))).otherwise(x))
    one = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.coalesce(*[F.when(_marked(x, words), form) for form, words in FORMS.items()], x))
    return F.array_join(one, " ")
