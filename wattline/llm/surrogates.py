r"""PII surrogates: detected entities get keyed, type-consistent replacements. DataFrame functions only.

Kinds: e-mail addresses, IPv4 addresses, IBANs, phone numbers, card numbers, US social security numbers, secrets
(``password=...``, AKIA ids) and names. A name is found after a title, after a cue (``Dear``, ``Name:``, ``Signed``), or
where it begins with a common given name; it may have inner capitals, apostrophes and words like ``de la``, behind a
title also initials and capitals only. Every other mention of a found name in the same document, full or surname
only, is found too.

An entity is its kind with its canonical value (lower-cased address, digits with the country code, value of a secret);
every mention of it, in whatever spelling and document, gets the same surrogate. A name is replaced part by part:
surnames by surnames, given names by given names of the gender that a title in the document gives that person
(else by neutral ones), in the name's script. So ``Mr. John Smith``, ``Dr. Smith``, ``John Smith`` and ``Smith`` in a document
stay one person, whatever the title.

The surrogate is a function of the key, the kind, the canonical value and an attempt number. Digits are
replaced by digits and letters by letters of the same case; separators, country codes, a card's first
digit and a domain's last label stay, octets keep their number of digits and remain valid, valid Luhn and IBAN
check digits remain valid.

Collision check: two entities of a kind whose surrogates agree, or a surrogate that is itself an entity
of the corpus, are resolved by further attempts, the entity with the smallest hash keeping its surrogate. From
attempt ``LOOSE`` on the format is widened where it may be too narrow (octets of any length, longer mailbox and surname),
and stays valid. Only what ``ATTEMPTS`` rounds leave (more entities of a fixed-length kind than half its values) gets
digits appended. So different entities keep different surrogates, whatever the corpus size. All this is joins and
aggregates on the distinct entities.

``pseudonymize`` returns doc_id, text, n_entities, one row per input row. Null text stays null (0
entities); null or repeated ids and equal rows are kept as they are. Texts without a mention pass unchanged; only
those that may have one are matched with the patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sized, stored

ATTEMPTS = 12
LOOSE = 4

# each pattern begins with a character class and looks behind only from there, so that most places fail at once
_EMAIL = r"[A-Za-z0-9._%+-](?<![A-Za-z0-9._%+-].)[A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?=[0-9])(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_IBAN = r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?=[+(0-9])(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
_CARD = r"[0-9](?<![0-9A-Za-z].)[0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9A-Za-z])"
_SSN = r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_ASSIGN = r"[PpSsTtAa](?i:(?<=p)assword|(?<=p)asswd|(?<=s)ecret|(?<=t)oken|(?<=a)pi_?key)[\"']?\x20{0,9}[:=]\x20{0,9}[\"']?"
_SECRET = rf"(?:AKIA[A-Z0-9]{{16,}}|{_ASSIGN}[A-Za-z0-9+/_.=-]{{6,}})"
#: Titles that announce a name, by gender.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
NEUTRAL = ("Dr", "Prof")
#: Common given names that begin a name by themselves, and words before one.
COMMON = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Hans Klaus Jürgen Pierre Jean Michel José Juan Carlos Иван Сергей Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Anna Maria Claudia Sabine Marie Sophie Carmen Ольга Елена"
CUES = ("Dear", "Signed", "Name", "Sincerely", "Regards", "Liebe", "Lieber", "Cher", "Chère", "Querido", "Querida", "Estimado", "Estimada")
_TITLE = rf"(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.? "
_CUE = rf"(?:{'|'.join(CUES)})[:,]? "
#: Words in small letters that names hold.
PARTICLES = "al bin da das de del den der di do dos du el ibn la le van von zu"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?"  # also McDonald, O'Brien
_WITHIN = rf"(?:(?:{'|'.join(PARTICLES.split())}) ){{0,3}}"
_ANY_WORD = rf"{_WITHIN}(?:{_WORD}|\p{{Lu}}\.(?= )|\p{{Lu}}{{2,}}(?!\p{{L}}))"  # behind a title also initials and capitals
_LEAD = rf"(?:(?:{_CUE})?(?:{_TITLE}){{1,2}}|{_CUE}(?={_WORD}[ ,.\n-])|(?=(?:{'|'.join(COMMON.split())})[ -]))"
_TITLED = rf"(?:{_CUE})?(?:{_TITLE}){{1,2}}{_ANY_WORD}(?:[ -]{_ANY_WORD}){{0,2}}(?!\p{{L}})"
_NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLED}|{_LEAD}{_WORD}(?:[ -]{_WITHIN}{_WORD}){{0,2}}(?!\p{{L}}))"
KINDS = {"secret": _SECRET, "email": _EMAIL, "ip": _IP, "iban": _IBAN, "ssn": _SSN, "card": _CARD, "phone": _PHONE, "name": _NAME}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Where none of these matches, ANY matches nowhere.
MAY = rf"[0-9@]|[:=][ \"']*[A-Za-z+/_.=-]{{6}}|AKIA|{_TITLE}(?:\p{{Lu}}|{'|'.join(PARTICLES.split())})|{_CUE}\p{{Lu}}|(?:{'|'.join(COMMON.split())})[ -](?:\p{{Lu}}|(?:{'|'.join(PARTICLES.split())}) )"
#: Given names by gender and script, and syllables of names by script.
GIVEN = {
    "latin": {"m": "Adam Bruno Carl David Erik Felix Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Simon", "f": "Alma Bella Clara Diana Elsa Flora Hanna Irma Julia Karla Lena Maria Nora Olga Paula Sara", "n": "Alex Andrea Chris Dominique Jamie Jordan Kim Lou Marin Nikita Robin Sam Sascha Toni Yael Zoe"},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл", "f": "Анна Вера Дарья Елена Ирина Мария Нина Ольга", "n": "Саша Женя Валя Слава Паша Шура Тоня Вика"},
}
ENDINGS = {"latin": {"m": "o", "f": "a", "n": "i"}, "cyrillic": {"m": "н", "f": "на", "n": "ша"}}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mi na ne no ra re ro sa se ta te to va ve", "cyrillic": "ба бе бо ва ве го да де до ка ке ко ла ле ло ма ме ми на не но ра ре ро са се та те то"}
#: Country calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def kind_of(value: Column) -> Column:
    """The kind of a value that ANY matched, by its shape; the order of ANY decides."""
    return reduce(lambda rest, k: F.when(value.rlike(rf"\A(?:{KINDS[k]})\z"), k).otherwise(rest), reversed([k for k in KINDS if k != "name"]), F.lit("name"))


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.regexp_replace(code, r"\A\+1(?=[0-9]{10}\z)", ""))  # a US number is the same with and without its code
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "secret", F.regexp_replace(value, rf"\A{_ASSIGN}", ""))
        .otherwise(value)
    )


def _code_length(value: Column) -> Column:
    """Characters of the plus sign and country code of a canonical phone number; 0 without one."""
    code = F.when(F.substring(value, 2, 1).isin("1", "7"), 2).when(F.substring(value, 2, 2).isin(*TWO_DIGIT_CODES.split()), 3).otherwise(4)
    return F.when(value.startswith("+"), code).otherwise(0)


def _number(hex_: Column, at: Column | int, n: Column | int, size: int = 4) -> Column:
    """A number below n from ``size`` hex digits of a hash."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(hex_, at + 1, F.lit(size)), 16, 10).cast("long") % n


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last place is the check digit."""
    back = F.reverse(F.split(digits, ""))
    d = F.transform(back, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """An IBAN's rest modulo 97, its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value."""
    h = F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), F.lit(i)), 256) for i in range(3)))
    loose = attempt >= LOOSE

    def swapped(c: Column, i: Column) -> Column:
        n = _number(h, (i * 3) % 186, 260, 3)
        letter = lambda base: F.char(F.lit(base) + n % 26)
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).otherwise(c)

    swap = lambda s: F.array_join(F.transform(F.split(s, ""), swapped), "")
    every = swap(value)
    behind = lambda n: F.concat(F.substr(value, F.lit(1), n), F.substr(every, n + 1))  # noqa: E731  all but the first n characters
    tail = F.regexp_extract(value, r"(\.[^.]*)\z", 1)
    longer = F.when(loose, F.array_join(F.transform(F.sequence(F.lit(0), attempt.cast("int")), lambda i: F.char(F.lit(97) + _number(h, 100 + i * 4, 26))), "")).otherwise("")
    email = F.concat(longer, swap(F.substr(value, F.lit(1), F.length(value) - F.length(tail))), tail)
    octet = F.transform(F.split(value, r"\."), lambda o, i: F.when(loose, _number(h, i * 4, 256)).when(F.length(o) == 1, _number(h, i * 4, 10)).when(F.length(o) == 2, 10 + _number(h, i * 4, 90)).otherwise(100 + _number(h, i * 4, 156)).cast("string"))
    keep1 = behind(F.lit(1))
    body = F.substr(keep1, F.lit(1), F.length(keep1) - 1)
    check = (F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_luhn_sum(value) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(keep1)
    free = behind(F.lit(4))
    blank = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.lit("00"), F.substr(free, F.lit(5)))
    iban = F.when(_mod97(value) == 1, F.concat(F.substr(blank, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(blank)).cast("string"), 2, "0"), F.substr(blank, F.lit(5)))).otherwise(behind(F.lit(2)))
    secret = F.when(value.startswith("AKIA"), behind(F.lit(4))).otherwise(every)

    def part(s: str) -> Column:
        """A surname, or a given name of the kind's gender: from the list first, coined in later attempts."""
        syllables = F.array(*map(F.lit, SYLLABLES[s].split()))
        coined = lambda n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(syllables, (_number(h, i * 4 + 4, len(SYLLABLES[s].split())) + 1).cast("int"))), ""))
        known = {g: F.element_at(F.array(*map(F.lit, names.split())), (_number(h, 0, len(names.split())) + 1).cast("int")) for g, names in GIVEN[s].items()}
        given = reduce(lambda rest, g: F.when(kind == f"given_{g}", F.when(attempt == 0, known[g]).otherwise(F.concat(coined(1 + attempt.cast("int")), F.lit(ENDINGS[s][g])))).otherwise(rest), "mf", F.when(attempt == 0, known["n"]).otherwise(F.concat(coined(1 + attempt.cast("int")), F.lit(ENDINGS[s]["n"]))))
        return F.when(kind == "surname", coined(3 + attempt.cast("int"))).otherwise(given)

    name = F.when(value.rlike(r"\p{IsCyrillic}"), part("cyrillic")).otherwise(part("latin"))
    return (
        F.when(kind == "email", email).when(kind == "ip", F.array_join(octet, ".")).when(kind == "card", card).when(kind == "iban", iban).when(kind == "secret", secret)
        .when(kind == "phone", behind(_code_length(value))).when(kind.startswith("given_") | (kind == "surname"), name).otherwise(every)
    )


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): distinct per kind, and none of them a value of ``entities``."""
    todo = stored(entities.select("kind", "value").distinct(), "entities")
    taken = todo.select("kind", F.col("value").alias("surrogate"))
    done = None
    for attempt in range(ATTEMPTS + 1):
        made = surrogate(F.col("kind"), F.col("value"), key, F.lit(attempt))
        if attempt == ATTEMPTS:
            made = F.concat(made, F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value"), 256), F.lit(1), F.lit(15)), 16, 10))
        won = todo.withColumn("surrogate", made)
        first = won.groupBy("kind", "surrogate").agg(F.min_by("value", F.struct(F.xxhash64("kind", "value"), "value")).alias("value"))
        won = first.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done, ["kind", "surrogate"], "left_anti")
        won = stored(won.select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.union(won)
        todo = stored(todo.join(won, ["kind", "value"], "left_anti"), "entities")
        if todo.isEmpty():
            break
    return done


def _written(kind: Column, mention: Column, value: Column, found: Column) -> Column:
    """The surrogate in the mention's spelling: its separators, its case, what stands before the value."""
    letters = F.regexp_replace(mention, "[^0-9A-Za-z]", "")
    plain = F.regexp_replace(found, r"[^0-9A-Za-z]", "")
    extra = F.length(letters) - F.length(plain)  # a country code that the canonical value lacks stays as it is
    nth = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    fill = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]") & (nth(i) > extra), F.substr(plain, nth(i) - extra, F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(found, i + 1, F.lit(1)))).otherwise(F.substr(found, i + 1, F.lit(1)))), "")
    before = F.substr(mention, F.lit(1), F.length(mention) - F.length(value))
    return F.when(kind == "email", F.when(F.length(found) == F.length(mention), cased).otherwise(found)).when(kind == "secret", F.concat(before, found)).when(kind == "ip", found).when(extra < 0, found).otherwise(fill)


def _named(mention: DataFrame) -> DataFrame:
    """Name mentions (name, mention) of documents as (name, mention, lead, bare, given, surname, gender)."""
    rest = F.regexp_replace("mention", rf"\A(?:(?:{_CUE})?(?:{_TITLE}){{1,2}}|{_CUE})", "")
    m = mention.withColumn("bare", rest).withColumn("lead", F.substr("mention", F.lit(1), F.length("mention") - F.length("bare")))
    title = F.regexp_extract("lead", rf"({_TITLE})\z", 1)
    word = F.regexp_replace(title, r"\.? \z", "")
    own = F.when(F.regexp_extract("lead", rf"(?:{'|'.join(MALE)})\.? ", 0) != "", "m").when(F.regexp_extract("lead", rf"(?:{'|'.join(FEMALE)})\.? ", 0) != "", "f")
    words = F.split("bare", "[ -]")
    only = (F.size(words) == 1) & (word == "")  # a lone name after a cue is a given name
    m = m.withColumns({"own": own, "surname": F.when(~only, F.element_at(words, -1)), "given": F.when(only, F.col("bare")).otherwise(F.when(F.size(words) > 1, F.substr("bare", F.lit(1), F.length("bare") - F.length(F.element_at(words, -1)) - 1)))})
    one = m.groupBy(F.col("name").alias("n_"), F.col("surname").alias("s_")).agg(F.when(F.min("own") == F.max("own"), F.min("own")).alias("g_"))
    m = m.join(one, (F.col("name") == F.col("n_")) & F.col("surname").eqNullSafe(F.col("s_")), "left")
    person = m.groupBy(F.col("name").alias("m_"), F.col("bare").alias("b_")).agg(F.when(F.min("own") == F.max("own"), F.min("own")).alias("p_"))
    m = m.join(person, (F.col("name") == F.col("m_")) & (F.col("bare") == F.col("b_")))
    return m.withColumn("gender", F.coalesce("p_", "own", "g_", F.lit("n"))).select("name", "mention", "lead", "bare", "given", "surname", "gender")


def _name_parts(named: DataFrame) -> DataFrame:
    """(name, mention, at, kind, value): the words of each name that have surrogates of their own."""
    given = F.transform(F.filter(F.split(F.coalesce("given", F.lit("")), "[ -]"), lambda w: w != ""), lambda w: F.struct(F.concat(F.lit("given_"), F.col("gender")).alias("kind"), w.alias("value")))
    last = F.when(F.col("surname").isNotNull(), F.array(F.struct(F.lit("surname").alias("kind"), F.col("surname").alias("value")))).otherwise(F.array())
    return named.select("name", "mention", F.posexplode(F.concat(given, last)).alias("at", "p")).select("name", "mention", "at", "p.kind", "p.value")


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("name", F.xxhash64("doc_id", F.xxhash64("text")))  # names a document; equal rows share it
    find = lambda pattern: F.regexp_extract_all("text", pattern, F.lit(0))
    first = stored(d.where(F.col("text").rlike(MAY)).select("name", find(F.lit(ANY)).alias("mentions")).where(F.size("mentions") > 0), "mentions")
    mention = stored(first.select("name", F.explode(F.array_distinct("mentions")).alias("mention")).distinct().withColumn("kind", kind_of(F.col("mention"))), "kinds")
    named = stored(_named(mention.where("kind = 'name'")), "names")

    # bare repeats of a document's names: (name, mention) rows of the same shape, with nothing before the name
    full = named.select("name", F.col("bare").alias("mention"), F.lit("").alias("lead"), "bare", "given", "surname", "gender").where("surname IS NOT NULL")
    alone = full.select("name", F.col("surname").alias("mention"), "lead", F.col("surname").alias("bare"), F.lit(None).cast("string").alias("given"), "surname", F.lit("n").alias("gender"))
    every = named.unionByName(full).unionByName(alone).groupBy("name", "mention").agg(F.min(F.struct("lead", "bare", "given", "surname", "gender")).alias("x")).select("name", "mention", "x.*")
    again = full.unionByName(alone).groupBy("name").agg(F.collect_set("mention").alias("w"))
    longest = F.array_sort("w", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    more = again.select("name", F.concat(F.lit(r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})")).alias("more"))

    other = mention.where("kind <> 'name'").withColumn("value", canonical(F.col("kind"), F.col("mention")))
    parts = stored(_name_parts(every), "name-parts")
    names = resolved(other.select("kind", "value").unionByName(parts.select("kind", "value")), key)
    said = other.join(names, ["kind", "value"]).select("name", "mention", _written(F.col("kind"), F.col("mention"), F.col("value"), F.col("surrogate")).alias("new"))
    made = parts.join(names, ["kind", "value"]).groupBy("name", "mention").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("s"))
    gaps = F.concat(F.regexp_extract_all(F.substr("mention", F.length("lead") + 1), F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    spelled = F.array_join(F.zip_with(F.transform("s", lambda x: x["surrogate"]), gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
    called = every.join(made, ["name", "mention"]).select("name", "mention", F.concat("lead", spelled).alias("new"))
    table = said.unionByName(called).groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("mention", "new"))).alias("new"))
    table = table.join(more, "name", "left").withColumnRenamed("name", "_name")

    has = sized(first.select(F.col("name").alias("_with")).distinct().withColumn("_has", F.lit(True)), "with-mentions")
    marked = d.join(has, F.col("name") == F.col("_with"), "left")
    plain = marked.where("_has IS NULL").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    joined = marked.where("_has").select("doc_id", "name", "text").join(table, F.col("name") == F.col("_name")).select("doc_id", "text", "new", "more")

    def rewritten(rows: DataFrame, pattern: Column) -> DataFrame:
        cut = rows.select("doc_id", "new", F.split("text", pattern, -1).alias("parts"), find(pattern).alias("mentions"))
        new = F.transform("mentions", lambda m: F.coalesce(F.element_at(F.col("new"), m), m))
        text = F.array_join(F.flatten(F.zip_with("parts", new, lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
        return cut.select("doc_id", text.alias("text"), F.size("mentions").cast("long").alias("n_entities"))

    return plain.union(rewritten(joined.where("more IS NULL"), F.lit(ANY))).union(rewritten(joined.where("more IS NOT NULL"), F.concat(F.lit(ANY), F.col("more"))))
