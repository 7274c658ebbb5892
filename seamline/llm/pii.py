"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Entities are found by one pattern, split into atoms (a name's given and family name are two) and
reduced to canonical form (digits of a telephone number, lower case of an address). Each distinct
atom draws a surrogate from a keyed hash; atoms whose surrogate another atom drew too, or which is
itself an atom of the corpus, draw again until none is left. Each occurrence then takes its atom's
surrogate in its own format. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Courtesy titles by the gender that they tell.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Г-н", "M", "Monsieur", "κ", "Κ", "κος", "Κος", "κύριος", "Κύριος", "κύριο", "Κύριο", "κύριε", "Κύριε", "κυρίου", "Κυρίου"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Señora", "Sra", "Г-жа", "Madame", "Mademoiselle", "Mlle", "κα", "Κα", "κυρία", "Κυρία", "κυρίας", "Κυρίας"],
    "x": ["Dr", "Prof"],
}
#: Given names that tell a name without a title, by gender.
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Andrew Peter Paul George Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Jacques François Luc Carlos José Juan Luis Miguel Pedro Иван Сергей Дмитрий Алексей Николай Νίκος Γιώργος Δημήτρης Κώστας".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Anna Emma Olivia Sophie Ursula Monika Petra Sabine Marie Jeanne Claire Camille María Carmen Ana Lucía Isabel Ольга Елена Наталья Татьяна Ирина Μαρία Ελένη Κατερίνα Σοφία".split(),
}
#: Titles of one letter need their full stop.
_ALL_TITLES = "|".join(f"{t}\\.?" if len(t) > 1 else f"{t}\\." for t in sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))
_ALL_GIVEN = "|".join(sorted((g for x in GIVEN.values() for g in x), key=len, reverse=True))
#: First letters of titles and given names, as few ranges.
_FIRST = "A-ZÀ-ÞΑ-ΩА-Яκ"
_WORD = r"(?:\p{Lu}[\p{L}'-]+|\p{Lo}[\p{L}\p{M}'-]*)"
#: Patterns by kind, in the order in which they are tried at a place; a look at the first character saves time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?=\d)(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?=[+(])(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})|\(\d{2,4}\))[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)",
    "phone in groups": r"(?=\d)(?<![\w+.-])(?:\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4}[ .-]?\d{3,4}[ .-]?\d{3,4})(?![\w-])",
    "phone in pairs": r"(?=[+0])(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d|0\d)(?:[ .-]\d{2}){4}(?!\w)",
    "phone with slash": r"(?=[+(0])(?<![\w+/])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{2,4}|\(?0\d{2,4}\)?) ?/ ?\d{3,4}[ .-]?\d{2,4}(?![\w/])",
    "name": rf"(?=[{_FIRST}])(?<!\p{{L}})(?:(?:{_ALL_TITLES}) {_WORD}(?: {_WORD})?|(?:{_ALL_GIVEN}) \p{{Lu}}[\p{{L}}'-]+)",
}
ANY = "|".join(PATTERNS.values())
#: Letters that names are made of, by script: consonants, vowels, and the ending of women's given names.
SCRIPTS = {
    "latin": ("bdfgklmnprstv", "aeiou", "a"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а"),
    "greek": ("βγδκλμνπρστ", "αεηιο", "α"),
    "armenian": ("բգդկլմնպրստ", "աեիոու", ""),
    "georgian": ("ბგდკლმნპრსტ", "აეიოუ", ""),
    "hebrew": ("בגדכלמנפרשת", "אוי", ""),
    "arabic": ("بتدرسكلمن", "اوي", ""),
    "devanagari": ("कगतदनपमरलस", "अइउएओ", ""),
    "thai": ("กคดตนบปมรล", "ะาอ", ""),
    "hangul": ("김이박최정강조윤", "민서준지현우영수", ""),
    "hiragana": ("かさたなはまらき", "あいうえおみりの", ""),
    "katakana": ("カサタナハマラキ", "アイウエオミリノ", ""),
    "han": ("王李张刘陈杨赵黄田山", "明华伟芳敏静中本川", ""),
}
ROUNDS = 40
KEY = "surrogates-1"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _at(letters: Column | str, value: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(letters, F.pmod(value, F.length(letters)).cast("int") + 1, F.lit(1))


def _draw(digest: Column, i: Column) -> Column:
    """The i-th (from 0) number drawn from a hex digest, again from its start after 64."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("long")


def kind_of(match: Column) -> Column:
    """Kind of a match of ANY."""
    digits = F.length(F.regexp_replace(match, r"\D", ""))
    return (
        F.when(F.contains(match, F.lit("@")), "email").when(match.rlike(r"^\d+(\.\d+){3}$"), "ip").when(match.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(match.rlike(r"^\p{L}"), "name").when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when((digits >= 13) & match.rlike(r"^\d") & ~F.contains(match, F.lit("/")), "card").otherwise("phone")
    )


def script_of(word: Column) -> Column:
    """Script of a word by its first letter; scripts without letters here count as Latin."""
    script = F.lit("latin")
    for name in [x for x in SCRIPTS if x != "latin"]:
        script = F.when(word.rlike(rf"^\p{{Is{name.capitalize()}}}"), name).otherwise(script)
    return script


def atoms(match: Column) -> Column:
    """array<struct<kind, canon>> of a match."""
    kind, titled = kind_of(match), match.rlike(rf"^(?:{_ALL_TITLES}) ")
    words = F.split(match, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    family = F.get(words, F.size(words) - 1)
    given = F.get(words, F.when(titled, 1).otherwise(0))
    told = F.when(titled & title.isin(TITLES["m"]), "m").when(titled & title.isin(TITLES["f"]), "f")
    gender = F.coalesce(told, F.when(given.isin(GIVEN["m"]), "m").when(given.isin(GIVEN["f"]), "f"), F.lit("x"))
    atom = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    last = atom(F.concat(F.lit("family-"), script_of(family)), F.lower(family))
    first = atom(F.concat_ws("-", F.lit("given"), script_of(given), gender), F.lower(given))
    canon = F.when(kind.isin("email"), F.lower(match)).when(kind == "ip", match).when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(F.regexp_replace(match, r"[^\d+]", ""))
    both = F.size(words) > F.when(titled, 2).otherwise(1)
    return F.when(kind == "name", F.when(both, F.array(first, last)).otherwise(F.array(last))).otherwise(F.array(atom(kind, canon)))


def _untitled(names: Column) -> Column:
    """Pattern of ANY and of the ``names`` found said otherwise: in full without a title, or by family name."""
    bare = F.transform(names, lambda x: F.regexp_replace(x, rf"^(?:{_ALL_TITLES}) ", ""))
    said = F.array_distinct(F.concat(bare, F.transform(bare, lambda x: F.element_at(F.split(x, " "), -1))))
    longest = F.transform(F.sort_array(F.transform(said, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    own = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_'-])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}_]|-\p{L})"))
    return F.when(F.size(names) > 0, own).otherwise(F.lit(ANY))


def _titled(match: Column, names: Column) -> Column:
    """struct<match, bare>: an untitled mention with the first word that it has elsewhere in ``names``."""
    whole = match.rlike(rf"^(?:(?:{_ALL_TITLES}) |(?:{_ALL_GIVEN}) \p{{Lu}})")
    bare = (kind_of(match) == "name") & ~whole
    before = F.regexp_extract(F.get(F.filter(names, lambda x: x.endswith(F.concat(F.lit(" "), match))), F.lit(0)), r"^(\S+ )", 1)
    return F.struct(F.when(bare, F.concat(before, match)).otherwise(match).alias("match"), bare.alias("bare"))


def _letters(canon: Column, digest: Column, skip: int = 0) -> Column:
    """Each letter and digit after the first ``skip`` characters replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        v = _draw(digest, i)
        return F.when(i < skip, c).when(c.rlike("[a-z]"), _at(_LOWER, v)).when(c.rlike("[A-Z]"), _at(_UPPER, v)).when(c.rlike("[0-9]"), _at(_DIGITS, v)).otherwise(c)

    return F.when(F.length(canon) > 0, F.array_join(F.transform(F.split(canon, ""), one), "")).otherwise("")


def _name(kind: Column, digest: Column, attempt: Column) -> Column:
    """Syllables of the script's letters; a given name ends by gender."""
    script = F.get(F.split(kind, "-"), F.lit(1))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, rule in SCRIPTS.items() for x in (name, rule[k])]), script)
    given = kind.startswith("given")
    pairs = F.when(script.isin("latin", "cyrillic", "greek", "armenian", "georgian"), F.when(given, 2).otherwise(3)).otherwise(0)
    syllables = F.transform(F.sequence(F.lit(0), pairs + F.floor(attempt / 4).cast("int")), lambda i: F.concat(_at(of(0), _draw(digest, 2 * i)), _at(of(1), _draw(digest, 2 * i + 1))))
    end = F.when(given & ~kind.endswith("-f") & ~kind.endswith("-m"), "").otherwise(F.concat(_at(of(0), _draw(digest, F.lit(60))), F.when(kind.endswith("-f"), of(2)).otherwise("")))
    return F.concat(F.array_join(syllables, ""), end)


def _iban(canon: Column, digest: Column) -> Column:
    """Country kept, letters and digits of the rest drawn by class, and right check digits."""
    rest = _letters(F.substring(canon, F.lit(5), F.length(canon)), digest)
    moved = F.concat(rest, F.substring(canon, 1, 2), F.lit("00"))

    def add(acc: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    left = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)
    return F.concat(F.substring(canon, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _card(canon: Column, digest: Column) -> Column:
    """As many digits, the same first one, and a right check digit."""
    body = F.concat(F.substring(canon, 1, 1), F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon) - 2), lambda i: _at(_DIGITS, _draw(digest, i))), ""))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        return acc + F.when(F.pmod(F.length(canon) - i, F.lit(2)) == 1, twice(d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(canon) - 1), F.lit(0), add)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def draw(atoms_: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt with sub: the surrogate that an atom draws at an attempt."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    digest = F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), F.lit(i)), 256) for i in range(4)))
    return atoms_.withColumn("digest", digest).withColumn("sub", surrogate(kind, canon, attempt, F.col("digest"))).drop("digest")


def surrogate(kind: Column, canon: Column, attempt: Column, digest: Column) -> Column:
    """The surrogate that an atom draws at an attempt, in canonical form."""
    phone = F.concat(F.when(canon.startswith("+"), F.substring(canon, F.lit(1), F.greatest(F.length(canon) - 10, F.lit(2)))).otherwise(""), F.array_join(F.transform(F.sequence(F.lit(1), F.when(canon.startswith("+"), F.length(canon) - F.greatest(F.length(canon) - 10, F.lit(2))).otherwise(F.length(canon))), lambda i: F.when(i == 1, _at("23456789", _draw(digest, i))).otherwise(_at(_DIGITS, _draw(digest, i)))), ""))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_draw(digest, i), F.lit(254)) + 1).cast("string")), ".")
    top = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    local = F.substring_index(canon, "@", 1)
    longer = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: _at(_LOWER, _draw(digest, i + 40))), "")).otherwise("")
    at = F.length(local) + 1
    email = F.concat(_letters(local, digest), longer, F.lit("@"), _letters(F.substring(canon, at + 1, F.length(canon) - at - F.length(top)), digest), top)
    number = lambda i, low, many, width: F.lpad((F.pmod(_draw(digest, F.lit(i)), F.lit(many)) + low).cast("string"), width, "0")
    ssn = F.concat(number(0, 100, 566, 3), number(1, 1, 99, 2), number(2, 1, 9999, 4))
    return (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "iban", _iban(canon, digest)).when(kind == "card", _card(canon, digest)).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(_name(kind, digest, attempt))
    )


def assign(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon) to (kind, canon, sub): a surrogate each, no two alike within a kind and none an atom of ``found``."""
    known = cut(found.select("kind", "canon").distinct())
    kind_class = F.when(F.col("kind").startswith("given"), "given").when(F.col("kind").startswith("family"), "family").otherwise(F.col("kind"))
    drawn = cut(draw(known.select("kind", "canon", F.lit(0).alias("attempt")), key))
    for _ in range(ROUNDS):
        tagged = drawn.withColumn("class", kind_class)
        first = tagged.groupBy("class", "sub").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon", "kind")).alias("f"))
        real = known.select(kind_class.alias("class"), F.col("canon").alias("sub")).distinct().withColumn("real", F.lit(True))
        bad = first.join(real, ["class", "sub"], "left").where("n > 1 or real").select("class", "sub", "f", F.coalesce("real", F.lit(False)).alias("real"))
        losers = tagged.join(bad, ["class", "sub"]).where(F.col("real") | ~((F.col("f.canon") == F.col("canon")) & (F.col("f.kind") == F.col("kind")))).select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        again = cut(draw(losers, key))
        if again.isEmpty():
            return drawn.select("kind", "canon", "sub")
        drawn = cut(drawn.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti").union(again.select(*drawn.columns)))
    raise RuntimeError(f"some entities of {ROUNDS} draws found no surrogate of their own")


def _poured(match: Column, digits: Column) -> Column:
    """The match with its digits (or letters and digits) replaced in turn, its separators kept."""
    plain = F.regexp_replace(digits, r"\+", "")

    def step(acc: Column, c: Column) -> Column:
        taken = c.rlike("[A-Za-z0-9]")
        return F.struct((acc["at"] + taken.cast("int")).alias("at"), F.concat(acc["out"], F.when(taken, F.substring(plain, acc["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(match, ""), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _cased(word: Column, sub: Column) -> Column:
    return F.when(word == F.upper(word), F.upper(sub)).when(F.substring(word, 1, 1) == F.lower(F.substring(word, 1, 1)), sub).otherwise(F.concat(F.upper(F.substring(sub, 1, 1)), F.substring(sub, F.lit(2), F.length(sub))))


def rendered(match: Column, subs: Column) -> Column:
    """A match with its atoms' surrogates (in order) in its own format."""
    kind, words = kind_of(match), F.split(match, " ")
    first, last = F.get(subs, F.lit(0)), F.get(subs, F.size(subs) - 1)
    family = F.get(words, F.size(words) - 1)
    titled = match.rlike(rf"^(?:{_ALL_TITLES}) ")
    named = F.when(~titled, F.concat_ws(" ", _cased(F.get(words, F.lit(0)), first), _cased(family, last))).when(F.size(words) > 2, F.concat_ws(" ", F.get(words, F.lit(0)), _cased(F.get(words, F.lit(1)), first), _cased(family, last))).otherwise(F.concat_ws(" ", F.get(words, F.lit(0)), _cased(family, last)))
    return F.when(kind == "name", named).when(kind == "email", F.when(match == F.upper(match), F.upper(first)).otherwise(first)).when(kind == "ip", first).otherwise(_poured(match, first))


def surrogates(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text column, and n_entities (int).

    Null texts stay null with 0 entities, empty ones empty. The same entity gets the same surrogate
    in every row and format, names with titles also where the same text says them without; repeated
    rows stay alike. Other columns stay; one named n_entities is
    replaced. Empty input gives an empty result. ``key`` fixes the surrogates for a given corpus.
    """
    docs = docs.drop("n_entities")
    text = F.col(f"`{text_col}`")
    maybe = F.coalesce(F.contains(text, F.lit("@")) | text.rlike("[0-9](?:[0-9]|[.][0-9][.][0-9]|[ -][0-9][ -][0-9])") | text.rlike(PATTERNS["name"]), F.lit(False))  # all that ANY needs to match
    whole, names_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]), F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)))
    if len(docs.columns) == 1:
        whole = F.struct(F.lit(None).cast("int").alias("none"))
    hit = docs.where(maybe).select(whole.alias("whole"), F.struct(F.xxhash64(text), F.sha2(text, 256)).alias("row"), text.alias("text"), names_of.alias("names"))
    any_of = _untitled(F.col("names"))
    found = F.transform(F.regexp_extract_all("text", any_of, F.lit(0)), lambda x: _titled(x, F.col("names")))
    hit = cut(hit.select("whole", "row", found.alias("found"), F.split("text", any_of, -1).alias("between")))  # written, so that texts are searched once
    each = cut(hit.select(F.explode(F.array_distinct(F.transform("found", lambda x: x["match"]))).alias("match")).distinct().select("match", F.posexplode(atoms(F.col("match"))).alias("at", "a")).select("match", "at", "a.kind", "a.canon"))
    subs = assign(each, key)
    table_of = each.join(subs, ["kind", "canon"]).groupBy("match").agg(F.sort_array(F.collect_list(F.struct("at", "sub"))).alias("s")).select("match", rendered(F.col("match"), F.col("s.sub")).alias("new"))
    texts = hit.where(F.size("found") > 0).select("row", "found").dropDuplicates(["row"])
    said = texts.select("row", F.posexplode("found").alias("at", "x")).select("row", "at", "x.match", "x.bare").join(table_of, "match").withColumn("new", F.when(F.col("bare"), F.regexp_replace("new", r"^\S+ ", "")).otherwise(F.col("new")))
    words = said.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"))
    built = F.array_join(F.transform("between", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new"), i)["new"], F.lit("")))), "")
    changed = hit.join(words, "row", "left").select("whole", built.alias("text"), F.size("found").alias("n"))
    column = lambda c: F.col("text") if c == text_col else F.col("whole").getField(c)
    out = changed.select(*[column(c).alias(c) for c in docs.columns], F.col("n").alias("n_entities"))
    return docs.where(~maybe).withColumn("n_entities", F.lit(0)).union(out)


def op2_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data: doc_id, n_entities, text."""
    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")
