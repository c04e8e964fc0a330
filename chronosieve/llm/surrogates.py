"""Surrogates for personal data, in DataFrame operations only.

Detected entities are replaced by keyed surrogates of their own type and format:
an e-mail address stays one with its top-level domain, a phone number keeps its
country code, spaces and brackets, a card number its first digit, separators and
valid check digit, a network address is a network address, a secret keeps length
and case, and a name with a title becomes a name of the same gender and script.

Coreference: what an entity becomes depends on the key and on its normal form
only, so all its mentions, however written, become the same. A name's normal form
is its words without title, full stop and case; the title's gender only chooses the
surrogate's ending. In a text that names somebody with a title, that person's later
mentions without one are replaced as well: the whole name, and its last word alone.
Not detected are names that nowhere in a text have a title.

Distinctness: the different entities of the whole corpus are collected by a distributed
aggregation, and where two would become the same, or one would become another
that is there, all but one draw again until none collide. Names and e-mail
addresses grow with each draw, by a syllable or by a character of the mail host, so
that there are always enough of them; all other formats keep their length and have
10**9 forms or more. Only these few are then
joined to the documents that mention them; all others are computed in place.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, load, shuffle_partitions

KEY = "surrogates-1"
# fixed values: what the entities look like
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ \-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])"
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
#: Titles before one word of a script without capitals, and forms of address after one to four characters.
PLAIN_TITLES = {"m": ["السيد", "מר"], "f": ["السيدة", "גברת"]}
HONORIFICS = ["さん", "様", "氏", "先生"]
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "zo", "han", "mer"],
    "cyrillic": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "зо", "хан", "мер"],
    "greek": ["βα", "δε", "φι", "γο", "κου", "λα", "με", "νι", "πο", "ρου", "σα", "τε", "βι", "ζο", "χαν", "μερ"],
    "arabic": ["با", "دي", "في", "كو", "لا", "مي", "ني", "رو", "سا", "تي", "زو", "حن", "مر", "جي", "نو", "را"],
    "hebrew": ["בא", "די", "פי", "גו", "קו", "לא", "מי", "ני", "פו", "רו", "סא", "טי", "וי", "זו", "חן", "מר"],
    "han": ["山", "川", "田", "中", "木", "林", "森", "石", "本", "村", "島", "原", "谷", "岡", "松", "竹"],
}
ENDINGS = {"latin": {"m": "n", "f": "a"}, "cyrillic": {"m": "н", "f": "а"}, "greek": {"m": "ς", "f": "α"}, "arabic": {"m": "ن", "f": "ة"}, "hebrew": {"m": "ן", "f": "ה"}, "han": {}}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_PLAIN = "|".join(t for ts in PLAIN_TITLES.values() for t in ts)
_HONORIFIC = "|".join(HONORIFICS)
#: A word of a name: capital first, hyphens and apostrophes inside (Jean-Luc, O'Neil), but not a possessive's.
WORD_OF_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{L}+|['’]\p{Lu}\p{L}+)*"
NAME = rf"(?<![\p{{L}}])(?:{_TITLE})\.? {WORD_OF_NAME}(?: {WORD_OF_NAME})?"
#: What a text without its entities consists of: words as names have them, other runs of letters, and all between.
PIECE = rf"{WORD_OF_NAME}|\p{{L}}+|[^\p{{L}}]+"
#: Groups into which the names of a text are dealt, so that a word is looked up among few of them.
GROUPS = 256
PLAIN_NAME = rf"(?<![\p{{L}}])(?:{_PLAIN}) [\p{{IsArabic}}\p{{IsHebrew}}]{{2,}}"
HONOURED = rf"(?<![\p{{IsHan}}])\p{{IsHan}}{{1,4}}(?:{_HONORIFIC})"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, ADDRESS, CARD, PHONE, NAME, PLAIN_NAME, HONOURED))
#: A text without this has no entity; cheaper than ANY.
MAYBE = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|[0-9A-Fa-f]{{32}}|(?:{_TITLE})\.? \p{{Lu}}|(?:{_PLAIN}) |(?:{_HONORIFIC})"
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"


def kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "address").when(m.rlike("^[0-9A-Fa-f]{32,}$"), "secret")
        .when(m.rlike(r"^[0-9]{4}(?:[ \-]?[0-9]{4}){3}$"), "card").when(m.rlike(r"^\p{L}"), "name").otherwise("phone")
    )


def title_of(m: Column) -> Column:
    return F.regexp_extract(m, rf"^(?:(?:{_TITLE})\.?|{_PLAIN}) ", 0)


def honorific_of(m: Column) -> Column:
    return F.regexp_extract(m, rf"(?:{_HONORIFIC})$", 0)


def named_in(m: Column) -> Column:
    """A name without its title or form of address."""
    return F.regexp_replace(m, rf"^(?:(?:{_TITLE})\.?|{_PLAIN}) |(?:{_HONORIFIC})$", "")


def gender_of(m: Column) -> Column:
    """m, f or n, by the title."""
    out = F.lit("n")
    for g in "mf":
        out = F.when(m.rlike(rf"^(?:{'|'.join([*TITLES[g], *PLAIN_TITLES[g]])})\.? "), g).otherwise(out)
    return out


def normal(m: Column, k: Column) -> Column:
    """The form that all mentions of an entity share; of a name, gender and words."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    name = F.concat(gender_of(m), F.lit(":"), F.lower(named_in(m)))
    return F.when(k.isin("card", "phone"), digits).when(k == "name", name).otherwise(ascii_lower(m))


def _byte(hexes: Column, i: Column) -> Column:
    """The i-th byte (from 1, round and round) of a hex digest, as a number."""
    at = F.pmod(i - 1, F.lit(32)) * 2
    nibble = lambda k: F.instr(F.lit(HEX), F.substr(hexes, at + k, F.lit(1))) - 1
    return nibble(1) * 16 + nibble(2)


def _nth(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _map_characters(s: Column, hexes: Column, letters: str = LETTERS, keep: Column | None = None) -> Column:
    """Digits become digits and lower-case letters letters; the first `keep` characters and all others stay."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(hexes, i + 1)
        new = F.when(c.between("0", "9"), _nth(HEX if letters == HEX else DIGITS, b)).when(c.between("a", "z"), _nth(letters, b)).otherwise(c)
        return new if keep is None else F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(s, "(?!^)"), one), "")


def _luhn(digits: Column) -> Column:
    """Sum modulo 10 of the Luhn scheme, the last digit counting once."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, x: a + x), F.lit(10))


def keyed_digest(k: Column, norm: Column, draw: Column, key: str) -> Column:
    # of a name only the words count, so that both genders begin alike
    return F.sha2(F.concat_ws("|", F.lit(key), k, F.when(k == "name", F.substr(norm, F.lit(3))).otherwise(norm), draw.cast("string")), 256)


def core(k: Column, norm: Column, hexes: Column, draw: Column) -> Column:
    """The surrogate of a normal form by its keyed digest, in normal form itself; names and e-mail addresses are longer by `draw` steps."""
    more = F.substr(hexes, F.lit(17), draw)
    local, top = F.substring_index(norm, "@", 1), F.substring_index(norm, ".", -1)
    email = F.concat(_map_characters(local, hexes), F.lit("@mail"), _nth(DIGITS, _byte(hexes, F.lit(32))), more, F.lit(".example."), top)
    octets = [F.pmod(_byte(hexes, F.lit(i)), F.lit(223 if i == 1 else 254)) + 1 for i in range(1, 5)]
    card = _map_characters(norm, hexes, keep=F.lit(1))
    unchecked = F.concat(F.substr(card, F.lit(1), F.length(card) - 1), F.lit("0"))
    checked = F.concat(F.substr(card, F.lit(1), F.length(card) - 1), F.pmod(10 - _luhn(unchecked), F.lit(10)).cast("string"))
    phone = _map_characters(norm, hexes, keep=F.when(F.length(norm) > 10, F.length(norm) - 10).otherwise(0))
    scripts = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "arabic": "IsArabic", "hebrew": "IsHebrew", "han": "IsHan"}

    def named(s: str) -> Column:
        words, syllables = [], F.array(*map(F.lit, SYLLABLES[s]))
        for w in (0, 1):
            parts = [F.element_at(syllables, F.pmod(_byte(hexes, F.lit(4 * w + j)), F.lit(len(SYLLABLES[s]))) + 1) for j in (1, 2, 3)]
            if w == 0:
                longer = F.array_join(F.transform(F.split(more, "(?!^)"), lambda c: F.element_at(syllables, F.instr(F.lit(HEX), c))), "")
                parts.append(F.when(draw > 0, longer).otherwise(""))
                parts += [F.when(F.substr(norm, F.lit(1), F.lit(1)) == g, e).otherwise("") for g, e in ENDINGS[s].items()]
            words.append(F.concat(*parts))
        return F.when(norm.contains(" "), F.concat_ws(" ", *words)).otherwise(words[0])

    name = named("latin")
    for s, script in scripts.items():
        name = F.when(norm.rlike(rf"\p{{{script}}}"), named(s)).otherwise(name)
    name = F.concat(F.substr(norm, F.lit(1), F.lit(2)), name)
    return (
        F.when(k == "email", email).when(k == "address", F.concat_ws(".", *[o.cast("string") for o in octets])).when(k == "secret", _map_characters(norm, hexes, HEX))
        .when(k == "card", F.when(_luhn(norm) == 0, checked).otherwise(card)).when(k == "phone", phone).otherwise(name)
    )


def rendered(m: Column, k: Column, c: Column) -> Column:
    """A surrogate in the format of the mention that it replaces."""
    n = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9]", ""))
    spaced = F.array_join(F.transform(F.split(m, "(?!^)"), lambda x, i: F.when(x.between("0", "9"), F.substr(c, n(i), F.lit(1))).otherwise(x)), "")
    capitals = ~m.rlike("[a-z]") & m.rlike("[A-Z]")
    words = F.substr(c, F.lit(3))
    words = F.when(named_in(m).rlike(r"\p{Ll}"), F.initcap(words)).otherwise(F.upper(words))
    name = F.concat(title_of(m), words, honorific_of(m))
    return F.when(k.isin("card", "phone"), spaced).when(k.isin("email", "secret") & capitals, F.upper(c)).when(k == "name", name).otherwise(c)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The different entities of a corpus: kind, norm, n (mentions)."""
    m = docs.where(F.col(text_col).rlike(MAYBE)).select(F.explode(F.regexp_extract_all(text_col, F.lit(ANY), 0)).alias("m"))
    return m.select(kind(F.col("m")).alias("kind"), "m").select("kind", normal(F.col("m"), F.col("kind")).alias("norm")).groupBy("kind", "norm").agg(F.count(F.lit(1)).alias("n"))


def resolved(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, draw of the entities that must not take their first draw; empty when none collide."""
    # dealt out anew: what adaptive execution has put into one partition would be drawn by one task
    found = found.repartition(shuffle_partitions(found.sparkSession), "kind", "norm")
    real = found.select("kind", F.col("norm").alias("core"))
    first = Window.partitionBy("kind", "core").orderBy(F.xxhash64("norm"), "norm")
    open_, taken, redrawn = found.select("kind", "norm"), None, None
    for draw in itertools.count():
        drawn = open_.withColumn("core", core(F.col("kind"), F.col("norm"), keyed_digest(F.col("kind"), F.col("norm"), F.lit(draw), key), F.lit(draw)))
        drawn = drawn.withColumn("fine", F.row_number().over(first) == 1)
        # it must be none that is there, nor one that an earlier draw gave out
        drawn = drawn.join(real.withColumn("there", F.lit(True)), ["kind", "core"], "left")
        if taken is not None:
            drawn = drawn.join(taken.withColumn("gone", F.lit(True)), ["kind", "core"], "left")
            drawn = drawn.withColumn("there", F.coalesce("there", "gone")).drop("gone")
        drawn = checkpointed(drawn.select("kind", "norm", "core", (F.col("fine") & F.col("there").isNull()).alias("fine")))
        good = drawn.where("fine").select("kind", "core")
        taken = good if taken is None else taken.unionByName(good)
        if draw:
            again = drawn.where("fine").select("kind", "norm", F.lit(draw).alias("draw"))
            redrawn = again if redrawn is None else redrawn.unionByName(again)
        open_ = drawn.where("not fine").select("kind", "norm")
        if open_.isEmpty():
            return redrawn if redrawn is not None else open_.withColumn("draw", F.lit(0))


def replaced(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with surrogates.

    Returns a row for every row of `docs`: doc_id, n_entities (mentions, those of names
    without their title too), kinds
    (sorted, joined by commas), changed, text. A null text stays null with 0
    entities; texts without entities stay as they are. Rows that repeat an id or have
    none are documents of their own. An empty table gives an empty result; other
    columns are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    redrawn = resolved(checkpointed(entities(rows)), key)
    found = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    # explode of a single element: the search runs once a row, not once for each use of its result
    rows = rows.select("*", F.explode(F.array(F.coalesce(found, F.array().cast("array<string>")))).alias("found"))
    if redrawn.isEmpty():
        draw = lambda k, n: F.lit(0)
    else:
        rows = rows.withColumn("text_key", F.xxhash64("text"))
        mentions = rows.where(F.size("found") > 0).select("doc_id", "text_key", F.explode(F.array_distinct("found")).alias("m")).withColumn("kind", kind(F.col("m")))
        mentions = mentions.withColumn("norm", normal(F.col("m"), F.col("kind"))).select("doc_id", "text_key", "kind", "norm").distinct()
        own = mentions.join(redrawn, ["kind", "norm"]).groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "draw"))).alias("draws"))
        own = own.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).hint("shuffle_hash")
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
        draw = lambda k, n: F.coalesce(F.try_element_at("draws", F.concat_ws("|", k, n)), F.lit(0))

    # step by step, so that no step is computed again for each use in the next
    steps = F.transform("found", lambda m: F.struct(m.alias("m"), kind(m).alias("k")))
    steps = F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), normal(x["m"], x["k"]).alias("n")))
    steps = F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), x["n"].alias("n"), draw(x["k"], x["n"]).alias("d")))
    steps = F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), x["n"].alias("n"), x["d"].alias("d"), keyed_digest(x["k"], x["n"], x["d"], key).alias("h")))
    steps = F.transform(steps, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), core(x["k"], x["n"], x["h"], x["d"]).alias("c")))
    made = F.transform(steps, lambda x: rendered(x["m"], x["k"], x["c"]))
    some = F.size("found") > 0
    nothing = F.array().cast("array<string>")
    rows = rows.select("*", F.explode(F.array(F.when(some, made).otherwise(nothing))).alias("made"))
    # persons named in this text: how they are called without a title, and what that becomes
    named = lambda m, s: F.when(kind(m) == "name", F.concat_ws("|", F.lower(named_in(m)), named_in(s)))
    names = F.filter(F.zip_with("found", "made", named), lambda x: x.isNotNull())
    # as strings, which Spark makes distinct by hashing
    rows = rows.select("*", F.explode(F.array(F.array_distinct(names))).alias("names"))
    last = lambda x: F.concat_ws("|", F.substring_index(F.substring_index(x, "|", 1), " ", -1), F.substring_index(F.substring_index(x, "|", -1), " ", -1))
    every = F.array_distinct(F.concat("names", F.transform(F.filter("names", lambda x: x.contains(" ")), last)))
    group = lambda name: F.pmod(F.hash(name), F.lit(GROUPS))
    person = lambda x: F.struct(F.substring_index(x, "|", 1).alias("name"), F.substring_index(x, "|", -1).alias("new"), group(F.substring_index(x, "|", 1)).alias("group"))
    rows = rows.select("*", F.explode(F.array(F.transform(every, person))).alias("persons"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.filter("persons", lambda x: x["group"] == g))
    rows = rows.select("*", F.explode(F.array(F.when(F.size("persons") > 0, groups))).alias("groups"))
    # the text between entities in pieces, each looked at once, so nothing that was put in is replaced again
    split = F.transform(F.split("text", ANY, -1), lambda p: F.regexp_extract_all(p, F.lit(PIECE), 0))
    rows = rows.select("*", F.explode(F.array(F.when(F.size("persons") > 0, split))).alias("split"))

    def called(words: Column, whole: bool) -> Column:
        """What a person of this text who is called so becomes; null if nobody is. In capitals only whole names count, as one word may be an acronym."""
        low = F.lower(words)
        new = F.get(F.filter(F.get("groups", group(low)), lambda x: x["name"] == low), F.lit(0))["new"]
        loud = (F.length(words) > 1) & (F.upper(words) == words) & (low != words)
        return F.when(words.rlike(r"^[\p{Lu}\p{Lo}]"), F.when(~loud, new).when(F.lit(whole), F.upper(new)))

    def looked_up(p: Column) -> Column:
        # a piece alone, and with the word after the space that follows it
        alone = F.transform(p, lambda x: F.struct(x.alias("x"), called(x, False).alias("one")))
        return F.transform(alone, lambda x, i: F.struct(x["x"].alias("x"), x["one"].alias("one"), F.when(F.get(p, i + 1) == " ", called(F.concat(x["x"], F.lit(" "), F.get(p, i + 2)), True)).alias("two")))

    rows = rows.select("*", F.explode(F.array(F.transform("split", looked_up))).alias("seen"))
    # a name of two words takes the pieces that it is made of, unless the name before it took the first
    two = lambda p, i: F.when(i >= 0, F.get(p, i)["two"])
    starts = lambda p, i: two(p, i).isNotNull() & two(p, i - 2).isNull()
    put = lambda p: F.transform(p, lambda x, i: F.when(starts(p, i), x["two"]).when(starts(p, i - 1) | starts(p, i - 2), "").otherwise(F.coalesce(x["one"], x["x"])))
    number = lambda p: F.size(F.filter(p, lambda x, i: starts(p, i) | (x["one"].isNotNull() & ~starts(p, i - 2))))
    pieces = F.when(F.col("seen").isNotNull(), F.transform("seen", lambda p: F.array_join(put(p), ""))).otherwise(F.split("text", ANY, -1))
    told = F.zip_with(pieces, "made", lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    hits = F.when(F.col("seen").isNotNull(), F.aggregate("seen", F.lit(0), lambda n, p: n + number(p))).otherwise(0)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", kind))), ",")
    return rows.select("doc_id", (F.size("found") + hits).cast("long").alias("n_entities"), kinds.alias("kinds"), some.alias("changed"), F.when(some, F.array_join(told, "")).otherwise(F.col("text")).alias("text"))


def op9(spark, sf_dir: str) -> DataFrame:
    return replaced(load(spark, sf_dir, "documents"))
