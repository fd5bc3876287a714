"""Surrogates for personal data, with DataFrame functions only: keyed, type-consistent replacements that keep gender, script and format.

Detected: e-mail addresses, IPv4 addresses, phone and card numbers, access keys, secrets (8 and more letters, digits, '_' and '-') after a telling word in
upper or lower case with = or : (and quotes, as in JSON), and names after titles. Phone numbers are North American ones, ten digits in a row that do not
begin like a time stamp, and + with a country code and 7 to 15 digits in any groups. Names are up to 16 capitalised words with initials, hyphens,
apostrophes and particles ('van', 'de la') between; where the same document has one of these words again without a title, it is replaced too. An entity is
known by its canonical form (letters lower-cased, signs left out; the last ten digits of a phone number, or those after another country code than 1; each
word of a name apart, the last one as surname; initials are shifted by a keyed number of letters), so all its
mentions, in whatever format and document, get one surrogate (coreference). The surrogate of an entity is drawn from a keyed SHA-256 of its
type and canonical form: character by character a letter of the same case and script or a digit, except that addresses stay
valid, card numbers keep their first digit and pass the Luhn check, e-mail domains are reserved ones, and names are built from syllables of the
script, given names with the ending of the gender that most of the name's titles have, wherever they stand. It is then written into the format of each mention.

Collisions: all distinct entities are checked against each other. Where two draw the same surrogate, or one draws a canonical form that really occurs,
the smallest entity (of the first kind) keeps it and the others draw again with the next round's key, until all are distinct. The pools grow with the
round, so that there is a free one for any number of entities: names get one more syllable and e-mail addresses one more digit every two rounds, secrets
lose their shape and then get longer, phone numbers get longer. A secret without letters and digits is drawn as letters from the start. Only addresses,
cards and access keys cannot grow (4e9, 1e14 a first digit, 1e16 at least); if they ran out, it would be an error after ROUNDS rounds.

Nulls: a null text stays null; null ids are allowed. Repeated rows get the same text. Other columns are kept. An empty table gives an empty result.

Scale: two passes over the texts; only distinct entities and the texts that have some are shuffled.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import compact, free_name, kept

KEY = "surrogates-1"
# Titles by gender, and syllables by script.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа", "Κυρία", "Madam", "Mlle", "Dame", "Sra", "Srta")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Г-н", "Κύριος", "Sir", "Hr", "Sr")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Mx", "Rev", "Доктор", "Профессор")
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "des", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "zu", "zur", "af", "av", "y", "e")
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "wi", "jo", "ku", "za"),
             "cyrillic": ("ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ви", "жо", "ку", "за"),
             "greek": ("βα", "δε", "φι", "γο", "λυ", "μα", "νε", "πι", "ρο", "συ", "τα", "βε", "κι", "ξο", "κυ", "ζα")}
ENDINGS = {"latin": ("na", "ren"), "cyrillic": ("на", "рен"), "greek": ("να", "ρος")}
DOMAINS = ("example.com", "example.net", "example.org")
ROUNDS = 64

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
# a grouped North American number; any international one; ten digits in a row, or eleven with the 1 in front
PHONE = (r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
         r"|\+[1-9](?:[ .\-/]{0,2}\(?[0-9]\)?){6,14}|[02-9][0-9]{9}|1[2-9][0-9]{9})(?![0-9A-Za-z])")
# + and the country code where it is not 1
COUNTRY = r"^\+(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}(?![0-9A-Za-z])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET_WORDS = ("password", "passwd", "token", "secret", "api_key", "apikey", "api-key")
SECRET = r"(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]{8})(?<=[=:]\s{0,3}[\"']?)(?<=(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-]++"
_APOSTROPHE = r"['’](?!(?:ll|ve|re)(?!\p{L}))\p{L}[\p{L}\p{M}]+"
NAME = rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]+(?:{_APOSTROPHE})*|{_APOSTROPHE})"
_WORD = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )*+(?:\p{{Lu}}\.[ \-]?|\p{{Lu}} )*+{NAME}(?:-{NAME})*+"
_TITLE = "(?:" + "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True)) + ")"
TITLES = rf"(?:{_TITLE}\.? )++"
PERSON = rf"(?<!\p{{L}}){TITLES}{_WORD}(?: {_WORD}){{0,15}}+"
# every entity begins where no ASCII letter or digit stands before it, so inside words nothing else is tried
ANY = r"(?<![A-Za-z0-9])(?:" + "|".join((EMAIL, IP, PHONE, CARD, ACCESS_KEY, SECRET, PERSON)) + ")"
# what a text with an entity has in any case
HINT = r"[0-9@]|AKIA|(?i:" + "|".join(SECRET_WORDS) + r")|(?<!\p{L})" + _TITLE + r"\.? \p{L}"
INITIALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _kind(mention: Column) -> Column:
    out = F.lit("secret")
    for name, pattern in (("person", PERSON), ("key", ACCESS_KEY), ("card", CARD), ("phone", PHONE), ("ip", IP), ("email", EMAIL)):
        out = F.when(mention.rlike(_whole(pattern)), name).otherwise(out)
    return out


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _initials(text: Column, key: str) -> Column:
    """Capital letters shifted in their alphabet by a number that the key decides; other capitals become X."""
    shift = int(hashlib.sha256(f"{key}|initials".encode()).hexdigest()[:8], 16) % 23 + 1
    other = F.regexp_replace(text, "[\\p{Lu}&&[^" + "".join(INITIALS) + "]]", "X")
    return F.translate(other, "".join(INITIALS), "".join(x[shift:] + x[:shift] for x in INITIALS))


def pieces(mention: Column, key: str = KEY) -> Column:
    """The parts of a mention that are replaced on their own: array<struct<before, type, canonical, raw>>; `before` stays as it is (its initials are shifted)."""
    kind = _kind(mention)
    titles = F.regexp_extract(mention, f"^{TITLES}", 0)
    name = F.substr(mention, F.length(titles) + F.lit(1))
    words, between = F.regexp_extract_all(name, F.lit(NAME), 0), F.split(name, NAME, -1)
    # the gender is that of the first title that has one
    gender = F.when(titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(FEMALE)})\.? "), "f_").when(titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(MALE)})\.? "), "m_").otherwise("n_")
    piece = lambda before, type_, raw, canonical: F.struct(before.alias("before"), type_.alias("type"), canonical.alias("canonical"), raw.alias("raw"))
    # parts of a hyphenated last word are surnames all
    surname = lambda i: ~F.exists(F.slice(between, i + 2, F.greatest(F.lit(0), F.size(words) - i - 1)), lambda x: x != "-")
    person = F.transform(words, lambda w, i: piece(
        F.concat(F.when(i == 0, titles).otherwise(""), _initials(F.get(between, i), key)),
        F.concat(F.when(surname(i), "surname_").otherwise(F.concat(F.lit("given_"), gender)), _script(w)), w, F.lower(w)))
    digits = lambda text: F.regexp_replace(text, "[^0-9]", "")
    prefix = F.regexp_extract(mention, COUNTRY, 0)
    national = F.substr(mention, F.length(prefix) + F.lit(1))
    abroad = F.array(piece(prefix, F.concat(F.lit("phone_"), F.substr(prefix, F.lit(2))), national, digits(F.regexp_replace(national, r"\(0\)", ""))))
    canonical = F.when(kind == "phone", F.right(digits(mention), F.lit(10))).when(kind == "card", digits(mention)).when(kind == "email", F.lower(mention)).otherwise(mention)
    return F.when(kind == "person", person).when((kind == "phone") & (prefix != ""), abroad).otherwise(F.array(piece(F.lit(""), kind, mention, canonical)))


def _byte(stream: Column, i: Column) -> Column:
    """Byte number i (from 0) of a hex string."""
    return F.conv(F.substr(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(stream: Column, i: Column, values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))[_byte(stream, i) % len(values)]


def _shaped(text: Column, stream: Column, hexadecimal: Column, signs: Column, digits: Column) -> Column:
    """Digits for digits and letters for letters, of the same case; other characters stay. In hexadecimal strings letters are a to f. Where `signs`
    (or `digits`) is true, these become letters too."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    width = F.when(hexadecimal, 6).otherwise(26)

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        letter = F.substr(letters, b % width + 1, F.lit(1))
        return F.when(c.rlike("[0-9]") & ~digits, (b % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(signs, letter).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit for the digits before it."""
    n = F.length(digits)
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    values = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return ((10 - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _name(type_: Column, stream: Column, more: int) -> Column:
    """Three or four syllables of the script, and `more`; given names end as their gender's do."""
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        stem = F.concat(*[_pick(stream, F.lit(i), syllables) for i in range(3 + more)])
        female, male = ENDINGS[script]
        name = (F.when(type_.startswith("given_f"), F.concat(stem, F.lit(female))).when(type_.startswith("given_m"), F.concat(stem, F.lit(male)))
                .otherwise(F.concat(stem, _pick(stream, F.lit(3 + more), syllables))))
        out = F.when(type_.endswith(script), name).otherwise(out)
    return out


def _once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row; a projection would be merged into every use, also inside lambdas."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def drawn(entities: DataFrame, round_: int, key: str) -> DataFrame:
    """Adds `surrogate`, the canonical form drawn in this round, to (type, canonical)."""
    type_, canonical = F.col("type"), F.col("canonical")
    more = min(round_ // 2, 14)         # syllables and digits; 16 and 10 times the pool each
    secret = type_ == "secret"
    signs = secret & (F.lit(round_ >= 2) | ~canonical.rlike("[A-Za-z0-9]"))
    unlike = secret & F.lit(round_ >= 4)
    blocks = F.sequence(F.lit(0), F.floor(F.length(canonical) / 32).cast("int"))
    entities = _once(entities, "stream", F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(round_)), type_, canonical, b.cast("string")), 256)), ""))
    stream = F.col("stream")
    address = F.concat_ws(".", *[(1 + _byte(stream, F.lit(i)) % 254).cast("string") for i in range(4)])
    entities = _once(_once(entities, "hex", canonical.rlike("^[0-9a-f]+$") & ~unlike), "shaped", _shaped(canonical, stream, F.col("hex"), signs, unlike))
    shaped, rest = F.col("shaped"), F.sha2(stream, 256)
    longer = (round_ - 2) // 2 if round_ >= 4 else 0
    tail = lambda n: F.right(F.lpad(F.conv(F.left(rest, F.lit(12)), 16, 10), 15, "0"), F.lit(n))
    entities = _once(entities, "body", F.when(type_ == "card", F.concat(F.left(canonical, F.lit(1)), F.substr(shaped, F.lit(2), F.length(canonical) - 2))))
    body = F.col("body")
    at = F.instr(canonical, "@")
    email = F.concat(F.left(shaped, at), F.lit("mail"), (_byte(stream, F.lit(30)) % 10).cast("string"), tail(more), F.lit("."), _pick(stream, F.lit(31), DOMAINS))
    phone = F.concat((2 + _byte(stream, F.lit(0)) % 8).cast("string"), F.substr(shaped, F.lit(2), F.length(canonical)), tail(min(longer, 14)))
    access_key = F.concat(F.lit("AKIA"), F.substr(shaped, F.lit(5), F.lit(16)))
    surrogate = (F.when(type_ == "ip", address).when(type_ == "card", F.concat(body, _luhn(body))).when(type_ == "email", email).when(type_.startswith("phone"), phone)
            .when(type_ == "key", access_key).when(type_.startswith("given_") | type_.startswith("surname_"), _name(type_, stream, more)).otherwise(F.concat(shaped, F.left(rest, F.lit(max(0, longer - 2))))))
    return entities.select("type", "canonical", surrogate.alias("surrogate"))


def written(type_: Column, raw: Column, surrogate: Column, shift: Column) -> Column:
    """A surrogate in the format of a mention: its digits into the places of the last digits (after the first `shift`), what it has more after them; its
    letters with the mention's capital."""
    n = F.length(surrogate)
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(
        F.concat(acc.text, F.when(acc.at < shift, c).otherwise(F.substr(surrogate, acc.at - shift + 1, F.lit(1)))).alias("text"), (acc.at + 1).alias("at"))).otherwise(
        F.struct(F.concat(acc.text, c).alias("text"), acc.at.alias("at")))
    digits = F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc.text, F.substr(surrogate, acc.at - shift + 1, n)))
    capital = F.concat(F.upper(F.left(surrogate, F.lit(1))), F.substr(surrogate, F.lit(2), n))
    name = F.when((F.upper(raw) == raw), F.upper(surrogate)).otherwise(capital)
    return F.when(type_.startswith("phone") | (type_ == "card"), digits).when(type_.startswith("given_") | type_.startswith("surname_"), name).otherwise(surrogate)


def assigned(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, canonical, surrogate) of distinct entities (type, canonical): within a type no surrogate twice, and none that is itself an entity."""
    left, done, round_ = entities.select("type", "canonical"), None, 0
    real = entities.select("type", F.col("canonical").alias("surrogate"))
    while True:
        tried = drawn(left, round_, key)
        free = tried.join(real, ["type", "surrogate"], "left_anti")
        free = free.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti") if done is not None else free
        won = free.groupBy("type", "surrogate").agg(F.min("canonical").alias("canonical")).select("type", "canonical", "surrogate")
        done = kept(compact(won if done is None else done.union(won)), "surrogates")
        left = kept(compact(left.join(done, ["type", "canonical"], "left_anti")), "left")
        if left.isEmpty():
            return done
        round_ += 1
        if round_ == ROUNDS:
            raise ValueError(f"no free surrogates left for {left.groupBy('type').count().collect()}")


def _one_gender(parts: DataFrame) -> DataFrame:
    """Parts of mentions with one type for each given name: the gender that most of its titles have, the female one in a tie, none if no title tells."""
    given, letter = F.col("type").startswith("given_"), F.substr("type", F.lit(7), F.lit(1))
    votes = parts.where(given).groupBy("canonical").agg(F.count(F.when(letter == "f", 1)).alias("f"), F.count(F.when(letter == "m", 1)).alias("m"))
    chosen = votes.select("canonical", F.when((F.col("f") >= F.col("m")) & (F.col("f") > 0), "f").when(F.col("m") > 0, "m").otherwise("n").alias("gender"))
    rest = F.substr("type", F.lit(8), F.length("type"))
    joined = parts.join(chosen, "canonical", "left").withColumn("type", F.when(given, F.concat(F.lit("given_"), F.col("gender"), rest)).otherwise(F.col("type")))
    return joined.select(*parts.columns)


def replaced(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key: str = KEY) -> DataFrame:
    """All rows and columns of `docs` with the text's entities replaced, and a last column n_entities (or n_entities_, ...): how many there were."""
    found, n, row, key_row, key_chars, new_parts, names, pattern = (free_name(docs, x) for x in ("mentions", "n_entities", "row_key", "row", "chars", "new", "names", "pattern"))
    marked = docs.withColumn(found, F.when(F.col(text_column).rlike(HINT), F.regexp_extract_all(text_column, F.lit(ANY), 0)))
    # words of names that stand after a title are looked for in the rest of that text too
    titled = F.filter(found, lambda m: m.rlike(f"^{TITLES}"))
    of_names = F.when(F.size(titled) > 0, F.flatten(F.transform(titled, lambda m: pieces(m, key))))
    also = F.concat(F.lit(rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?iu:"), F.array_join(F.array_distinct(F.transform(names, lambda p: p.canonical)), "|"), F.lit(r")(?![\p{L}\p{M}])"))
    with_some = _once(marked.where(F.size(found) > 0), names, of_names).withColumn(pattern, F.when(F.col(names).isNotNull(), F.concat(F.lit(f"({ANY})|"), also)))
    of_titled = F.regexp_extract_all(text_column, F.col(pattern), F.lit(1))
    untitled = lambda m, i: F.when(F.get(of_titled, i) == "", F.get(F.filter(names, lambda p: p.canonical == F.lower(m)), F.lit(0)))
    all_ = F.when(F.col(names).isNotNull(), F.transform(F.regexp_extract_all(text_column, F.col(pattern), F.lit(0)), lambda m, i: F.struct(m.alias("mention"), untitled(m, i).alias("name")))).otherwise(
        F.transform(found, lambda m: F.struct(m.alias("mention"), F.lit(None).cast("struct<before:string,type:string,canonical:string,raw:string>").alias("name"))))
    with_some = kept(with_some.withColumn(found, all_).drop(names).withColumn(row, F.xxhash64(id_column, text_column)), "texts")
    mentions = with_some.select(F.col(row).alias("row"), F.length(text_column).alias("chars"), F.posexplode(found).alias("at", "m")).select("row", "chars", "at", "m.*").distinct()
    name = F.struct(F.lit("").alias("before"), F.col("name.type").alias("type"), F.col("name.canonical").alias("canonical"), F.col("mention").alias("raw"))
    parts = mentions.select("row", "chars", "at", F.posexplode(F.when(F.col("name").isNotNull(), F.array(name)).otherwise(pieces(F.col("mention"), key))).alias("part", "p"))
    parts = kept(_one_gender(parts.select("row", "chars", "at", "part", "p.*")), "mentions")
    known = assigned(parts.select("type", "canonical").distinct(), key)
    new = _once(parts.join(known, ["type", "canonical"]), "shift", F.greatest(F.lit(0), F.length(F.regexp_replace("raw", "[^0-9]", "")) - F.length("surrogate")))
    new = new.select("row", "chars", "at", "part", F.concat("before", written(F.col("type"), F.col("raw"), F.col("surrogate"), F.col("shift"))).alias("new"))
    # per mention its parts in order, per text its mentions in order
    whole = new.groupBy("row", "chars", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x.new), "").alias("new"))
    lists = whole.groupBy("row", "chars").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x.new).alias("new"))
    between = F.when(F.col(pattern).isNotNull(), F.split(text_column, F.col(pattern), -1)).otherwise(F.split(text_column, ANY, -1))
    text = F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(F.col(new_parts), i), F.lit(""))))), "")
    lists = kept(lists, "replacements").toDF(key_row, key_chars, new_parts).hint("merge")
    changed = with_some.join(lists, (F.col(row) == F.col(key_row)) & (F.length(text_column) == F.col(key_chars)))
    columns = docs.columns
    changed = changed.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in columns], F.size(found).cast("long").alias(n))
    same = marked.where(F.coalesce(F.size(found) <= 0, F.lit(True))).select(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("long").alias(n))
    return same.union(changed)
