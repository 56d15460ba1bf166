"""Personal data replaced by surrogates, with DataFrame functions only.

One expression finds mail addresses, phone numbers, IPv4 addresses, card and
social security numbers, IBANs and titled names.  Each entity gets a surrogate
of its own type that depends on a key and on the entity alone, so one entity
has one surrogate in every document:

* digits (phones after the country code, which is known by its digits, cards, social security numbers,
  IBANs) and IPv4 addresses go through a keyed Feistel network, a bijection on
  strings of their length: distinct entities stay distinct by construction and
  separators stay where they are.  The last digit of a card whose check digit
  is right is recomputed, so the surrogate's is right too;
* mail addresses get a keyed local part in a reserved domain, in capitals if
  the address was;
* names are replaced word by word, given names from a list that fits the
  gender of the titles and the script, surnames by keyed syllables of the
  script; so ``Ms. Weber`` and ``Dr. Anna Weber`` still share a surname.  A
  person's gender is what the titles before the whole name agree on anywhere in
  the input, so ``Ms. Anna Weber`` and ``Dr. Anna Weber`` share a given name too.

What is no bijection is checked: the distinct mail addresses, surnames and whole
names of the whole input are grouped by surrogate, and all but the least of those that share one (or that
meet a real entity) are drawn again until none does; names grow by a syllable
with each draw, so that no pool runs out.  The few drawn again, and those whose gender another mention tells,
travel to their own documents by a join on the id.

The key is the caller's secret: who knows it can undo the bijections.  There is
no default; the registered query takes it from ``spark.rowgraph.pii.key`` and,
where that is unset, uses a public demonstration key.

Only what has a form is found: names need a title.  Patterns hold no group that
recurses with the length of a text.  Most texts hold none of the characters that
an entity needs (``@``, a digit, a title with a capital after it), which two quick
searches tell; only the others are searched by the whole pattern.

Defined results: a null text stays null, an empty one empty; documents without
an entity are unchanged; repeated rows get the same text; other columns pass
through, and helper columns carry a prefix that no table should use (``_pii``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.llm.expressions import let
from rowgraph.runtime import cut

_MALE = ["Mr", "Sir", "Herr", "Señor", "Monsieur", "Don", "Г-н", "г-н"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Doña", "Г-жа", "г-жа"]
_EITHER = ["Dr", "Prof"]
_TITLES = "|".join(sorted(_MALE + _FEMALE + _EITHER, key=len, reverse=True))

_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)"
_PHONE = (
    r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}]|[.-]\d)"
)
_SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
_CARD = r"(?<![\p{L}\p{N}.-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}]|[.-]\d)"
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}[\p{{Ll}}\p{{M}}'’-]+(?: \p{{Lu}}[\p{{Ll}}\p{{M}}'’-]+){{0,2}}"

_NUMBERS = "|".join(f"(?:{p})" for p in (_PHONE, _IP, _SSN, _CARD))
_INITIALS = "".join(sorted({t[0] for t in _MALE + _FEMALE + _EITHER}))
#: All but mail, sorted by what they begin with.
_REST = rf"(?=[+(\d])(?:{_NUMBERS})|(?=[A-Z])(?:{_IBAN})|(?=[{_INITIALS}])(?:{_NAME})"
#: What is looked for; the first alternative that matches at a place wins.  No alternative
#: begins within a word, which the first test says once for all of them.
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_MAIL})|{_REST})"
#: The same for a text without ``@``: few characters begin anything else, so most places fail at one test.
WITHOUT_MAIL = rf"(?=[+(\dA-Z{_INITIALS}])(?<![\p{{L}}\p{{N}}])(?:{_REST})"


def _title(latin: bool, also: str = "") -> str:
    """A title and a capital after it, of the Latin titles or the others; ``also`` are characters that count as well."""
    some = [t for t in _MALE + _FEMALE + _EITHER if t[0].isascii() == latin]
    tails = "|".join(sorted({t[1:] for t in some}, key=len, reverse=True))
    return rf"[{also}{''.join(sorted({t[0] for t in some}))}](?:{f'(?<=[{also}])|' if also else ''}(?:{tails})\.? \p{{Lu}})"


#: A text with no ``@`` and none of these has no entity, and one with no ``@`` and no title has no drawn surrogate.
#: Each begins with one set of characters, those of ASCII apart, which is what the search is fast at.
_DIGIT_OR_TITLE, _TITLE, _TITLE_BEYOND = _title(True, "0-9"), _title(True), _title(False)

#: The country codes of E.164: of one digit, of two, the rest of three.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_GIVEN = {
    ("male", "latin"): "Adrian Bruno Carlos Dennis Edgar Felix Gregor Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("female", "latin"): "Alma Berta Clara Diana Elena Fiona Greta Helena Irene Julia Karla Laura Maria Nina Olga Paula".split(),
    ("either", "latin"): "Alex Andrea Chris Dana Eli Frankie Jamie Jean Kim Lee Luca Noel Robin Sam Sascha Toni".split(),
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("female", "cyrillic"): "Алла Белла Вера Галина Дарья Ева Жанна Зоя Инна Кира Лариса Мария Нина Ольга Полина Раиса".split(),
    ("either", "cyrillic"): "Женя Саша Валя Шура Слава Паша Тоня Лёня Миша Гоша Ника Тося Юля Яна Вася Лера".split(),
}
_SYLLABLES = {
    "latin": "ba de fi go ha ke li mo na po ra se ti vo we zu".split(),
    "cyrillic": "ба де фи го ха ке ли мо на по ра се ти во ве зу".split(),
}


def _digest(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[F.lit(p) if isinstance(p, (str, int)) else p for p in parts]), 256)


def _number(digest: Column, modulus: Column) -> Column:
    """A number below ``modulus`` from the first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def _power(digits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), (digits + 1).cast("int"))


def _feistel(key: str, tag: str, left: Column, right: Column, ml: Column, mr: Column) -> tuple[Column, Column]:
    """Six rounds on two numbers below ``ml`` and ``mr``; returns a struct of both."""
    state = F.struct(left.alias("l"), right.alias("r"))
    for k in range(6):
        if k % 2 == 0:
            state = let(state, lambda s, k=k: F.struct(
                ((s["l"] + _number(_digest(key, tag, k, s["r"]), ml)) % ml).alias("l"), s["r"].alias("r")))
        else:
            state = let(state, lambda s, k=k: F.struct(
                s["l"].alias("l"), ((s["r"] + _number(_digest(key, tag, k, s["l"]), mr)) % mr).alias("r")))
    return state


def _map_digits(key: str, tag: str, digits: Column) -> Column:
    """A bijection on digit strings of each length from 2 to 36."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    return let(a, lambda a: let(n - a, lambda b: let(
        _feistel(key, tag, digits.substr(F.lit(1), a).cast("long"), digits.substr(a + 1, b).cast("long"), _power(a), _power(b)),
        lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), b, "0")))))


def _fill_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    gaps = F.split(shape, "[0-9]", -1)
    return F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, digits.substr(i + 1, F.lit(1)))))


def _luhn(digits: Column) -> Column:
    """Check sum of a digit string, its last digit being the check digit."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: let(
            digits.substr(i, F.lit(1)).cast("int"),
            lambda d: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d),
        ),
    )
    return F.aggregate(each, F.lit(0), lambda x, y: x + y) % 10


def _card(key: str, digits: Column) -> Column:
    """Cards with a right check digit map among themselves by their other digits."""
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    fresh = let(_map_digits(key, "card", body), lambda b: F.concat(
        b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
    # the others keep their distance from the right check digit
    right = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    off = (digits.substr(F.length(digits), F.lit(1)).cast("int") - right + 10) % 10
    return let(F.struct(fresh.alias("f"), off.alias("o")), lambda s: F.concat(
        s["f"].substr(F.lit(1), F.length(s["f"]) - 1),
        ((s["f"].substr(F.length(s["f"]), F.lit(1)).cast("int") + s["o"]) % 10).cast("string")))


def _address(key: str, ip: Column) -> Column:
    parts = F.transform(F.split(ip, r"\."), lambda x: x.cast("long"))
    half = F.lit(65536).cast("long")
    state = let(parts, lambda p: _feistel(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], half, half))
    return let(state, lambda s: F.concat_ws(
        ".", *[x.cast("long").cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))


def _letters(digest: Column, many: int) -> Column:
    return F.translate(F.substring(digest, 1, many), "0123456789abcdef", "abcdefghijklmnop")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def _pick(items: list[str], digest: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.conv(F.substring(digest, at, 1), 16, 10).cast("int") + 1))


def _given(digest: Column, gender: Column, script: Column) -> Column:
    out = F.lit(None).cast("string")
    for (g, s), names in _GIVEN.items():
        out = F.when((gender == g) & (script == s), _pick(names, digest, 9)).otherwise(out)
    return out


def _more(digest: Column, script: Column, attempt: Column) -> Column:
    """A syllable for each draw after the first, six at most."""
    def made(s: str) -> Column:
        return F.concat(*[F.when(attempt >= k, _pick(_SYLLABLES[s], digest, 20 + k)).otherwise("") for k in range(1, 7)])

    return F.when(script == "cyrillic", made("cyrillic")).otherwise(made("latin"))


def _given_words(key: str, words: Column, gender: Column, attempt: Column) -> Column:
    """The surrogates of all words of a name but the last."""
    return F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda x: let(
        F.when(attempt > 0, _digest(key, "given", x, attempt.cast("string"))).otherwise(_digest(key, "given", x)),
        lambda d: F.concat(_given(d, gender, _script(x)), _more(d, _script(x), attempt))))


def _surname(digest: Column, script: Column) -> Column:
    def made(s: str) -> Column:
        return F.initcap(F.concat(*[_pick(_SYLLABLES[s], digest, k) for k in range(1, 6)]))

    return F.when(script == "cyrillic", made("cyrillic")).otherwise(made("latin"))


def _by_pattern(text: Column, made: Callable[[str], Column], none: Column) -> Column:
    """``made`` with the least pattern that finds all entities of ``text``; ``none`` where there can be none."""
    some = text.rlike(_DIGIT_OR_TITLE) | text.rlike(_TITLE_BEYOND)
    return F.when(text.contains("@"), made(ENTITY)).when(some, made(WITHOUT_MAIL)).otherwise(none)


def entities(text: Column) -> Column:
    """All entities of a text, in order; none of a null text."""
    return _by_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.array().cast("array<string>"))


def gaps(text: Column) -> Column:
    """What stands before, between and after the entities of a text."""
    return _by_pattern(text, lambda p: F.split(text, p, -1), F.array(text))


def kind_of(e: Column) -> Column:
    """The type of an entity, by its form."""
    return (
        F.when(e.contains("@"), F.lit("mail"))
        .when(e.rlike(rf"^(?:{_TITLES})\.? "), F.lit("name"))
        .when(e.rlike("^[A-Z]"), F.lit("iban"))
        .when(e.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.lit("ip"))
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn"))
        .when(e.startswith("+") | e.startswith("(") | e.rlike(r"^\d{3}[.-]\d{3}[.-]\d{4}$"), F.lit("phone"))
        .otherwise(F.lit("card"))
    )


def canonical(kind: Column, e: Column) -> Column:
    """What makes two mentions one entity: case of mail, separators of numbers."""
    return (
        F.when(kind == "mail", F.lower(e))
        .when(kind == "name", F.regexp_replace(e, rf"^(?:{_TITLES})\.? ", ""))
        .when(kind == "ip", e)
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .otherwise(F.regexp_replace(e, "[^0-9+]", ""))
    )


def _gender(e: Column) -> Column:
    return (
        F.when(e.rlike(rf"^(?:{'|'.join(_MALE)})\.? "), F.lit("male"))
        .when(e.rlike(rf"^(?:{'|'.join(_FEMALE)})\.? "), F.lit("female"))
        .otherwise(F.lit("either"))
    )


def drawn_words(e: Column) -> Column:
    """The parts of an entity whose surrogates are drawn, not bijective: ``kind``, ``canon``, ``gender``.

    Given names are drawn for the whole name, by the gender of its titles.
    """
    kind = kind_of(e)
    name = canonical(F.lit("name"), e)
    words = F.split(name, " ")

    def part(kind: str, canon: Column, gender: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), canon.alias("canon"), gender.alias("gender"))

    none = F.lit(None).cast("string")
    last = part("surname", F.element_at(words, -1), none)
    return (
        F.when(kind == "mail", F.array(part("mail", F.lower(e), none)))
        .when((kind == "name") & (F.size(words) > 1), F.array(last, part("given", name, _gender(e))))
        .when(kind == "name", F.array(last))
        .otherwise(F.array().cast("array<struct<kind:string,canon:string,gender:string>>"))
    )


def drawn(key: str, kind: Column, canon: Column, attempt: Column, gender: Column | None = None) -> Column:
    """A drawn surrogate; of ``given`` it is that of the given names and the real surname, whose surrogate is its own."""
    d = _digest(key, kind, canon, attempt.cast("string"))
    made = F.when(
        kind == "mail", let(d, lambda d: F.concat(_letters(d, 16), F.lit("@mail.example.org")))
    ).otherwise(let(d, lambda d: F.concat(_surname(d, _script(canon)), _more(d, _script(canon), attempt))))
    if gender is None:
        return made
    words = F.split(canon, " ")
    return F.when(kind == "given", F.concat_ws(" ", _given_words(key, words, gender, attempt), F.element_at(words, -1))).otherwise(made)


def surrogate(key: str, e: Column, attempts: Column | None = None) -> Column:
    """The replacement for entity ``e``; ``attempts`` maps ``kind:canon`` to its draw and gender."""

    def known(kind: str, canon: Column, field: str, otherwise: Column) -> Column:
        if attempts is None:
            return otherwise
        return F.coalesce(F.try_element_at(attempts, F.concat(F.lit(kind + ":"), canon))[field], otherwise)

    def tries(kind: str, canon: Column) -> Column:
        return known(kind, canon, "attempt", F.lit(0))

    def mail(e: Column) -> Column:
        return let(F.lower(e), lambda c: let(drawn(key, F.lit("mail"), c, tries("mail", c)), lambda s: F.when(
            (F.upper(e) == e) & (c != e), F.upper(s)).otherwise(s)))

    def name(e: Column) -> Column:
        title = F.regexp_extract(e, rf"^(?:{_TITLES})\.? ", 0)
        canon = canonical(F.lit("name"), e)
        tuned = F.struct(
            canon.alias("canon"), F.split(canon, " ").alias("words"),
            tries("given", canon).alias("attempt"), known("given", canon, "gender", _gender(e)).alias("gender"),
        )
        last = lambda n: F.element_at(n["words"], -1)
        return let(tuned, lambda n: F.concat(title, F.concat_ws(
            " ", _given_words(key, n["words"], n["gender"], n["attempt"]), drawn(key, F.lit("surname"), last(n), tries("surname", last(n))))))

    def phone(e: Column) -> Column:
        # the country code stays; it follows from the digits, so separators do not matter
        return let(canonical(F.lit("phone"), e), lambda c: let(F.regexp_extract(c, _COUNTRY, 1), lambda code: let(
            F.regexp_replace(c, "[^0-9]", ""), lambda d: _fill_digits(
                e, F.concat(code, _map_digits(key, "phone", d.substr(F.length(code) + 1, F.length(d))))))))

    def digits(tag: str) -> Callable[[Column], Column]:
        return lambda e: let(F.regexp_replace(e, "[^0-9]", ""), lambda d: _fill_digits(
            e, _card(key, d) if tag == "card" else _map_digits(key, tag, d)))

    kind = kind_of(e)
    return let(kind, lambda k: F.when(k == "mail", mail(e)).when(k == "name", name(e)).when(k == "phone", phone(e))
               .when(k == "ip", _address(key, e)).when(k == "ssn", digits("ssn")(e)).when(k == "iban", digits("iban")(e))
               .otherwise(digits("card")(e)))


def _redraw(docs: DataFrame, key: str, text_col: str, id_col: str) -> DataFrame | None:
    """``(id, attempts)`` for documents with an entity that had to be drawn again, or None."""
    text = F.col(text_col)
    found = (
        docs.filter(text.contains("@") | text.rlike(_TITLE) | text.rlike(_TITLE_BEYOND))
        .select(F.col(id_col).alias("_pii_id"), F.explode(entities(text)).alias("e"))
        .select("_pii_id", F.explode(drawn_words(F.col("e"))).alias("w"))
        .select("_pii_id", "w.kind", "w.canon", "w.gender")
        .distinct()
    )
    found = cut(found)
    # titles of one gender decide; a name with both, or with neither, is of either
    male, female = F.coalesce(F.max(F.col("gender") == "male"), F.lit(False)), F.coalesce(F.max(F.col("gender") == "female"), F.lit(False))
    agreed = F.when(male & ~female, "male").when(female & ~male, "female").otherwise("either")
    genders = found.groupBy("kind", "canon").agg(agreed.alias("agreed"))
    pending = cut(genders.withColumn("attempt", F.lit(0)))
    for _ in range(64):
        made = pending.withColumn("made", drawn(key, F.col("kind"), F.col("canon"), F.col("attempt"), F.col("agreed")))
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("least"), F.count(F.lit(1)).alias("n"))
        real = made.filter("kind <> 'given'").select("kind", F.col("canon").alias("made")).distinct().withColumn("real", F.lit(True))
        judged = made.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        bad = F.col("real").isNotNull() | ((F.col("n") > 1) & (F.col("canon") != F.col("least")))
        pending = cut(judged.select("kind", "canon", "agreed", F.when(bad, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), bad.alias("bad")))
        if not pending.filter("bad").limit(1).count():
            break
        pending = pending.drop("bad")
    else:
        raise RuntimeError("the pools of surrogates are too small for the distinct entities")
    moved = (
        found.join(pending.select("kind", "canon", "attempt", "agreed"), ["kind", "canon"])
        .filter((F.col("attempt") > 0) | (F.col("gender") != F.col("agreed")))
        .select("_pii_id", F.concat_ws(":", "kind", "canon").alias("name"), F.struct("attempt", F.col("agreed").alias("gender")).alias("draw"))
        .distinct()
    )
    if not moved.limit(1).count():
        return None
    return moved.groupBy("_pii_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "draw"))).alias("_pii_attempts"))


def replace_entities(
    docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", count_col: str | None = None
) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; ``count_col`` adds how many."""
    if not key:
        raise ValueError("a key is needed")
    columns = docs.columns
    moved = _redraw(docs, key, text_col, id_col)
    if moved is not None:
        docs = docs.join(moved, F.col(id_col).eqNullSafe(F.col("_pii_id")), "left").drop("_pii_id")
    attempts = F.col("_pii_attempts") if moved is not None else None
    found = docs.withColumn("_pii", entities(F.col(text_col)))
    fresh = F.transform("_pii", lambda e: surrogate(key, e, attempts))
    parts = F.zip_with(gaps(F.col(text_col)), fresh, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    replaced = F.when(F.size("_pii") > 0, F.concat_ws("", parts)).otherwise(F.col(text_col))
    out = [replaced.alias(c) if c == text_col else F.col(c) for c in columns]
    if count_col:
        out.append(F.greatest(F.size("_pii"), F.lit(0)).cast("long").alias(count_col))
    return found.select(*out)


def key_of(spark: SparkSession) -> str:
    """The session's secret, or a public key good for demonstrations only."""
    return spark.conf.get("spark.rowgraph.pii.key", None) or "demonstration"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, key_of(spark), count_col="n_entities")
