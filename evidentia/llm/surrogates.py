"""Surrogates for personal data (operator 2), in DataFrame operations only.

E-mail, IPv4 and IPv6 addresses, IBANs, card numbers, national ids, phone numbers and names of persons are replaced by
keyed stand-ins of the same type and form: letters stay letters and digits digits, separators stay where they are, valid
check digits stay valid, names keep their gender, script, capitals and number of words. A stand-in depends on the secret
key and the entity, so an entity has one stand-in wherever it occurs and however it is written (coreference). Names are
replaced word by word, so "Mr. Smith" and "John Smith" go on sharing their family name.

Persons are found by a form of address, a word of introduction before the name ("my name is"), a listed given name before
a family name, or, in scripts without capitals, by family name and honorific. A phone number with and one without a
country code are different entities.

The distinct entities are a small table by themselves. Each proposes a stand-in; a proposal that is some real entity of
the corpus, or that another entity has or proposes too, is made again with the next attempt number, until all are
settled: different entities never share a stand-in, and no stand-in points at something real. A form so full that ATTEMPTS
do not suffice is an error. Listed given names are moved along their list by the key instead, which keeps them distinct.

The patterns are searched once in each text, and the matches written beside the rows; only texts that have entities are
rebuilt, each from its gaps and its stand-ins in turn.

Defined results: a null text stays null and has no entities; empty and clean texts stay as they are; repeated rows stay
repeated, with equal results; columns besides text stay as they are, and the new column is `entities`, or entities_1 and
so on if there is one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, table

#: Given names by script and gender, and forms of address by gender. They find names and stand in for them.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Carla Carmen Clara Claire Elena Elisa Emma Eva Hannah Ingrid Isabel Jane Julia Laura Lucia Maria Marie Martha Mary Nora Olivia Paula Petra Rosa Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Albert Antonio Bernard Carlos Daniel David Diego Emil Erik Felix Frank George Hans Henri Hugo Jacques James Jean John Jorge Karl Louis Lucas Luis Mark Martin Michael Otto Paul Pedro Peter Pierre Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("greek", "m"): "Γιάννης Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
ADDRESS = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Signora Госпожа Κυρία السيدة श्रीमती".split(),
    "m": "Mr Herr Monsieur Señor Sr Signor Господин Κύριος السيد श्री".split(),
    None: "Dr Prof Professor Doctor".split(),
}
INTRODUCTIONS = ["name is", "Name is", "name:", "Name:", "m'appelle", "me llamo", "Me llamo", "ich heiße", "Ich heiße", "Name ist", "меня зовут", "Меня зовут", "με λένε"]
#: Family names and honorifics of scripts without capitals.
HAN_FAMILIES, HAN_HONORIFICS = "王 李 张 刘 陈 杨 赵 黄 周 吴 佐藤 鈴木 高橋 田中".split(), "先生 女士 小姐 さん 様".split()
HANGUL_FAMILIES, HANGUL_HONORIFICS = "김 이 박 최 정".split(), "씨 님".split()
#: Syllables of made-up names.
SYLLABLES = {
    "latin": "ba be bo bra da de do dre fa fi ga go gri ha hel ka ko kra la le lin lo ma mar me mo na nel no pa pe ra re ri ro sa sel so sta ta te to tor va vel vi".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
    "greek": "βα γα δα θα κα κο λα λε λο μα με μο να νε νο πα πε ρα ρο σα σε τα το φα φι".split(),
    "arabic": "با تا جا دا را سا شا طا فا قا كا لا ما نا وا".split(),
    "devanagari": "का खा गा चा जा ता दा ना पा बा मा रा ला वा सा".split(),
    "han": "伟 芳 明 丽 军 强 敏 静 杰 娟 勇 艳 涛 霞 平 刚 玲 超 秀 兰".split(),
    "hangul": "가 나 다 라 마 바 사 아 자 하 민 준 서 지 수 현".split(),
}
SCRIPTS = {"cyrillic": "Cyrillic", "greek": "Greek", "arabic": "Arabic", "devanagari": "Devanagari", "han": "Han", "hangul": "Hangul"}
#: Rounds of proposals at most.
ATTEMPTS = 64

_WORD = r"(?:\p{Lu}[\p{L}\p{M}'’-]++)"
_NAMES = "|".join(f for names in GIVEN.values() for n in names for f in (n, n.upper()))
_FORMS = [f for titles in ADDRESS.values() for t in titles for f in dict.fromkeys((t, t.upper()))]
_TITLES = "|".join(sorted(_FORMS, key=len, reverse=True))
#: Possessive runs that begin only where their class begins: time stays linear in the text's length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}+(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9@-])",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![\w-])(?<=\d[A-Z0-9 ]{9,40})",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]{0,12}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+)?+)(?![\w:]|\.\d)",
    "ipv4": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "id": r"(?<![\w.,+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "number": r"(?<![\w.,+-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d(?:[ .()-]{0,2}+\d){7,14}+|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|0\d(?:[ .-]\d{2}){4})(?![\w-])",
    "person": rf"(?=[\p{{Lu}}\p{{Lo}}])(?<!\p{{L}})(?:(?:{_TITLES})\.? (?:{_WORD}(?: {_WORD}){{0,2}}+|[\p{{Lo}}\p{{M}}]{{2,}}+(?: [\p{{Lo}}\p{{M}}]{{2,}}+)?+)|(?:{_NAMES}) {_WORD}(?: {_WORD})?+"
    rf"|(?<=(?:{'|'.join(INTRODUCTIONS)}) ){_WORD}(?: {_WORD}){{0,2}}+)"
    rf"|(?:{'|'.join(HAN_FAMILIES)})\p{{IsHan}}{{0,2}}(?=(?:{'|'.join(HAN_HONORIFICS)}))|(?<!\p{{L}})(?:{'|'.join(HANGUL_FAMILIES)})\p{{IsHangul}}{{1,2}}(?= ?(?:{'|'.join(HANGUL_HONORIFICS)}))",
}
_ORDER = ("email", "iban", "ipv6", "ipv4", "id", "number", "phone", "person")
#: One pattern for all types. Nearly all places in a text are within a word or begin a plain one, so cheap looks at one
#: character go before the types that need it.
COMBINED = (
    rf"(?<![A-Za-z0-9_])(?:{PATTERNS['email']}|(?=[A-Z]{{2}}\d){PATTERNS['iban']}|{PATTERNS['ipv6']}|(?=[\d+(])(?:{'|'.join(PATTERNS[k] for k in ('ipv4', 'id', 'number', 'phone'))}))"
    rf"|(?=[\p{{Lu}}\p{{Lo}}])(?:{PATTERNS['person']})"
)
#: Types whose stand-ins are digits put into the places of digits.
_DIGITS = ("phone", "number", "id")


def _kind(surface: Column) -> Column:
    """The first type whose pattern the whole match has."""
    out = F.lit("person")
    for k in reversed(_ORDER[:-1]):
        out = F.when(surface.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


def _titled(surface: Column) -> tuple[Column, Column]:
    """The form of address before a name, with its space, and the name."""
    title = F.regexp_extract(surface, rf"^((?:{_TITLES})\.? )", 1)
    return title, F.substring(surface, F.length(title) + 1, F.length(surface))


def _canonical(kind: Column, surface: Column) -> Column:
    """What different spellings of an entity have in common."""
    return (
        F.when(kind.isin(*_DIGITS), F.regexp_replace(surface, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "person", F.lower(_titled(surface)[1]))
        .otherwise(F.lower(surface))
    )


def _draw(key: str, what: Column, n: int | Column) -> Column:
    """A keyed number below n."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), what), 256), 1, 12), 16, 10).cast("long") % n).cast("int")


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), at + 1)


def _script(text: Column) -> Column:
    out = F.lit("latin")
    for name, unicode in SCRIPTS.items():
        out = F.when(text.rlike(rf"\p{{Is{unicode}}}"), F.lit(name)).otherwise(out)
    return out


def _gender(title: Column, name: Column) -> Column:
    bare, out = F.lower(F.regexp_replace(title, r"\.? $", "")), F.lit(None).cast("string")
    for g in "mf":
        first = [n.lower() for (_, gender), names in GIVEN.items() if gender == g for n in names]
        out = F.when(bare.isin([t.lower() for t in ADDRESS[g]]) | F.split(name, " ")[0].isin(first), F.lit(g)).otherwise(out)
    return out


def _reshaped(key: str, canon: Column, attempt: Column, keep: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Character by character, digits by digits and letters by letters; characters from place `keep` on stay."""

    def one(i: Column) -> Column:
        c = F.substring(canon, i, F.lit(1))
        seed = F.concat_ws("\x1f", canon, attempt, i)
        return (
            F.when(i >= keep, c)
            .when(c.rlike("[0-9]"), _draw(key, seed, 10).cast("string"))
            .when(c.rlike("[a-z]"), _pick(list(alphabet), _draw(key, seed, len(alphabet))))
            .when(c.rlike("[A-Z]"), _pick(list(alphabet.upper()), _draw(key, seed, len(alphabet))))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), one), "")


def _check_digit(digits: Column) -> Column:
    """The Luhn sum of digits, modulo 10."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.floor(d * 2 / 10).cast("int") + d * 2 % 10)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    """The remainder that IBANs are checked by, letters counting 10 to 35."""

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _proposed(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    seed = F.concat_ws("\x1f", kind, canon, attempt)
    # from the fifth attempt on, a longer local part: short forms can run out
    more = F.when(attempt > 3, F.concat(*(_pick(list("abcdefghijklmnopqrstuvwxyz"), _draw(key, F.concat(seed, F.lit(k)), 26)) for k in "xyz"))).otherwise("")
    last_dot = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    whole = F.length(canon) + 1
    email = F.concat(more, _reshaped(key, canon, attempt, last_dot))
    ipv4 = F.concat_ws(".", *((_draw(key, F.concat(seed, F.lit(f"/{k}")), 254) + 1).cast("string") for k in range(4)))
    ipv6 = _reshaped(key, canon, attempt, whole, "abcdef")
    drawn = _reshaped(key, canon, attempt, whole)
    digits = F.concat(F.substring(canon, 1, 1), F.substring(drawn, F.lit(2), F.length(canon)))
    # the check digit: valid stays valid, invalid stays invalid
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    right = (10 - _check_digit(F.concat(body, F.lit("0")))) % 10
    wrong = (right + 1 + _draw(key, F.concat(seed, F.lit("wrong")), 9)) % 10
    number = F.concat(body, F.when(_check_digit(canon) == 0, right).otherwise(wrong).cast("string"))
    country, account = F.substring(canon, 1, 2), F.substring(drawn, F.lit(5), F.length(canon))
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    check = 98 - _mod97(F.concat(account, country, F.lit("00")))
    check = F.when(valid, check).otherwise((check + 1 + _draw(key, F.concat(seed, F.lit("wrong")), 90)) % 97)
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

    def word(script: str) -> Column:
        """Made-up syllables, more from attempt to attempt; given names end as their gender does."""
        few = F.least(F.length(canon), F.lit(3)) if script in ("han", "hangul") else F.lit(3)  # as long as the name in these scripts
        parts = F.transform(F.sequence(F.lit(1), few + F.floor(attempt / 2).cast("int")), lambda k: _pick(SYLLABLES[script], _draw(key, F.concat_ws("\x1f", seed, k), len(SYLLABLES[script]))))
        ending = {"latin": ("na", "no"), "cyrillic": ("на", "н"), "greek": ("να", "νος")}.get(script)
        end = F.when((kind == "given") & (gender == "f"), ending[0]).when((kind == "given") & (gender == "m"), ending[1]).otherwise("") if ending else F.lit("")
        return F.concat(F.array_join(parts, ""), end)

    name = word("latin")
    for script in SCRIPTS:
        name = F.when(_script(canon) == script, word(script)).otherwise(name)
    out = name
    for k, v in (("email", email), ("ipv4", ipv4), ("ipv6", ipv6), ("number", number), ("iban", iban), ("phone", digits), ("id", drawn)):
        out = F.when(kind == k, v).otherwise(out)
    return out


def _moved(key: str, word: Column) -> Column:
    """A listed given name, moved along the list of its script and gender as far as the key says; null for other words."""
    out = F.lit(None).cast("string")
    for (script, g), names in GIVEN.items():
        lower = [n.lower() for n in names]
        step = 1 + _draw(key, F.lit(f"{script} {g}"), len(names) - 1)
        at = F.array_position(F.array(*map(F.lit, lower)), word)
        out = F.when(at > 0, _pick(lower, ((at - 1 + step) % len(names)).cast("int"))).otherwise(out)
    return out


def _rendered(kind: Column, surface: Column, stand_in: Column) -> Column:
    """The stand-in in the spelling of the entity: its separators, its form of address, its capitals."""
    def character(state: Column, i: Column) -> Column:
        c = F.substring(surface, i, F.lit(1))
        taken = F.when(kind == "iban", c != " ").otherwise(c.rlike("[0-9]"))
        at = state["at"] + taken.cast("int")
        return F.struct(F.concat(state["out"], F.when(taken, F.substring(stand_in, at, F.lit(1))).otherwise(c)).alias("out"), at.alias("at"))

    spaced = F.aggregate(F.sequence(F.lit(1), F.length(surface)), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), character)["out"]
    title, name = _titled(surface)
    person = F.concat(title, F.when((F.upper(name) == name) & (F.length(name) > 1), F.upper(stand_in)).otherwise(F.initcap(stand_in)))
    shout = (F.upper(surface) == surface) & surface.rlike("[A-Z]")
    other = F.when(shout, F.upper(stand_in)).otherwise(stand_in)
    return F.when(kind.isin("iban", *_DIGITS), spaced).when(kind == "person", person).otherwise(other)


def stand_ins(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, stand_in for distinct (kind, canon, gender): no stand-in twice in a kind, none that is an entity itself."""
    spark = entities.sparkSession
    real = entities.select("kind", F.col("canon").alias("proposal"))
    settled, open_ = None, entities
    for attempt in range(ATTEMPTS):
        spread = open_.repartition(spark.sparkContext.defaultParallelism)  # few bytes but much work: not to be put into one task
        proposals = stage(spread.withColumn("proposal", _proposed(key, F.col("kind"), F.col("canon"), F.col("gender"), F.lit(attempt))), "proposals")
        free = proposals.join(real, ["kind", "proposal"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", F.col("stand_in").alias("proposal")), ["kind", "proposal"], "left_anti")
        first = free.groupBy("kind", "proposal").agg(F.min("canon").alias("canon"))  # of entities that propose the same, one gets it
        new = stage(first.select("kind", "canon", F.col("proposal").alias("stand_in")), "settled")
        settled = new if settled is None else settled.unionByName(new)
        open_ = stage(proposals.drop("proposal").join(new, ["kind", "canon"], "left_anti"), "open")
        if open_.isEmpty():
            return settled
    raise ValueError(f"no free stand-ins of the same form after {ATTEMPTS} attempts: {[tuple(r) for r in open_.groupBy('kind').count().collect()]}")


def _name_words(surfaces: DataFrame) -> DataFrame:
    """canon, at, kind, word, gender of the words of names: the first of several is given, the others are family names."""
    names = surfaces.where("kind = 'person'").groupBy("canon").agg(F.min("gender").alias("gender"))
    words = names.select("canon", "gender", F.size(F.split("canon", " ")).alias("n"), F.posexplode(F.split("canon", " ")).alias("at", "word"))
    given = (F.col("at") == 0) & (F.col("n") > 1)
    return words.select("canon", "at", F.when(given, "given").otherwise("family").alias("kind"), "word", F.when(given, F.col("gender")).alias("gender"))


def replacements(surfaces: DataFrame, key: str) -> DataFrame:
    """kind, canon, stand_in of every entity: of names from those of their words."""
    words = stage(_name_words(surfaces).withColumn("moved", F.when(F.col("kind") == "given", _moved(key, F.col("word")))), "words")
    of_words = words.where("moved is null").groupBy("kind", F.col("word").alias("canon")).agg(F.min("gender").alias("gender"))
    of_others = surfaces.where("kind != 'person'").select("kind", "canon", F.lit(None).cast("string").alias("gender")).distinct()
    chosen = stand_ins(stage(of_others.unionByName(of_words), "entities"), key)
    found = words.join(chosen.select("kind", F.col("canon").alias("word"), "stand_in"), ["kind", "word"], "left")
    one = F.struct("at", F.coalesce("moved", "stand_in").alias("w"))
    names = found.groupBy("canon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["w"]), " ").alias("stand_in"))
    return chosen.where("kind not in ('given', 'family')").unionByName(names.select(F.lit("person").alias("kind"), "canon", "stand_in"))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with their texts rewritten, and entities: array of (kind, surface, stand_in) in order of occurrence."""
    kinds = "array<struct<kind:string,surface:string,stand_in:string>>"
    columns, out, m = docs.columns, free_name(docs, "entities"), free_name(docs, "matches")
    every = [F.col(f"`{c}`") for c in columns]
    searched = stage(docs.withColumn(m, F.regexp_extract_all("text", F.lit(COMBINED), F.lit(0))), "searched")
    has = F.coalesce(F.size(m) > 0, F.lit(False))
    clean = searched.where(~has).select(*every, F.array().cast(kinds).alias(out))
    hash_ = free_name(searched, "hash")
    found = searched.where(has).withColumn(hash_, F.sha2("text", 256))
    # equal texts have equal entities: each text once
    matches = found.groupBy(F.col(hash_).alias("text_hash")).agg(F.first(m).alias("m"))
    placed = stage(matches.select("text_hash", F.posexplode("m").alias("at", "surface")), "matches")
    surfaces = placed.select("surface").distinct().withColumn("kind", _kind(F.col("surface")))
    surfaces = surfaces.withColumn("canon", _canonical(F.col("kind"), F.col("surface")))
    person = _titled(F.col("surface"))
    surfaces = stage(surfaces.withColumn("gender", F.when(F.col("kind") == "person", _gender(person[0], F.lower(person[1])))), "surfaces")
    chosen = stage(replacements(surfaces, key), "chosen")
    rendered = surfaces.join(chosen, ["kind", "canon"]).select("surface", "kind", _rendered(F.col("kind"), F.col("surface"), F.col("stand_in")).alias("stand_in"))
    # both sides of the joins are written: a surface or a text with very many rows is split, or its one row sent to all
    one = F.struct("at", "kind", "surface", "stand_in")
    lists = stage(placed.join(stage(rendered, "rendered"), "surface").groupBy("text_hash").agg(F.array_sort(F.collect_list(one)).alias("e")), "lists")
    rebuilt = found.select(F.struct(*every).alias("row"), hash_).join(lists, F.col(hash_) == F.col("text_hash"))
    gaps = F.split("row.text", COMBINED, -1)
    stand = F.concat(F.col("e.stand_in"), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, stand, lambda gap, s: F.concat(gap, s)), "")
    entities = F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["surface"].alias("surface"), x["stand_in"].alias("stand_in"))).cast(kinds)
    rebuilt = rebuilt.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns), entities.alias(out))
    return clean.unionByName(rebuilt)


#: The key of the query below. A real run takes its own from where it keeps its secrets.
QUERY_KEY = "a key for tests only"


def query(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates; entities without their real surfaces."""
    found = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join("entities.kind", " ").alias("kinds"), F.array_join("entities.stand_in", "\n").alias("stand_ins"))


SQL = None
