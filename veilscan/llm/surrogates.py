"""Surrogates for personal data, with Spark's own functions only.

Entities are found by pattern and brought to a canonical form per kind, so that every way of writing one entity is one
entity. Each gets a surrogate drawn from a keyed hash of kind, canonical form and attempt: digits for digits, letters for
letters, octets in range, card numbers with a right check digit where the original had one, names of the same gender
and script. Names and mailboxes grow with each attempt. A surrogate that another entity took first, or that is itself an entity of the corpus, is drawn again, until
all are distinct; the table of them then gives one surrogate per entity over the whole corpus, written back in each
occurrence's own format (separators, case).

Texts without entities are never shuffled. Of the others, only occurrences meet the table of surrogates, in a join whose
hot keys Spark splits.

Edge cases: a null text stays null, an empty one empty; a null doc_id is carried through; repeated rows get the same
text; without entities texts stay as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import text_or_empty, written

# Fixed patterns, in order of precedence ---------------------------------------------------------
MALE, FEMALE, EITHER = ("Mr", "Herr", "Monsieur", "Señor", "Sr"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"), ("Dr", "Prof")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLE = "(?:" + "|".join(sorted((*MALE, *FEMALE, *EITHER, "Г-н", "Г-жа"), key=len, reverse=True)) + ")"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "dialled": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}]){TITLE}\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?(?![\p{{L}}])",
}
KINDS = {"email": "email", "ip": "ip", "ssn": "ssn", "phone": "phone", "dialled": "phone", "card": "card", "name": "name"}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
GATE = rf"[0-9@]|(?<![\p{{L}}]){TITLE}\.? "
#: Syllables of made-up names, per script: any two and an ending that reads as the gender's.
SYLLABLES = {"latin": ["bal", "cor", "del", "fen", "gar", "hol", "jun", "kel", "lor", "mar", "nor", "pel", "rin", "sol", "tav", "vel"],
             "cyrillic": ["бал", "вер", "гор", "дан", "жел", "зор", "кел", "лор", "мар", "нор", "пел", "рин", "сол", "тав", "фел", "хол"]}
ENDINGS = {("latin", "m"): ["o", "us"], ("latin", "f"): ["a", "ia"], ("latin", "n"): ["en", "is"],
           ("cyrillic", "m"): ["ий", "ов"], ("cyrillic", "f"): ["ая", "ова"], ("cyrillic", "n"): ["ен", "ис"]}


def kind_of(match: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(KINDS[name])) if out is None else out.when(test, F.lit(KINDS[name]))
    return out.otherwise(F.lit("card"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^({TITLE}\.?) ", 1)


def canonical(kind: Column, match: Column) -> Column:
    """Emails lower-cased; numbers as digits, a phone's country prefix set apart; names without title, with gender and script."""
    title = F.rtrim(_title(match), F.lit("."))
    gender = F.when(title.isin(*MALE, "Г-н"), "m").when(title.isin(*FEMALE, "Г-жа"), "f").otherwise("n")
    name = F.substring_index(match, " ", -1)
    first = F.regexp_replace(match, rf"^{TITLE}\.? ", "")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    national = F.right(digits(match), F.lit(10))
    return F.when(kind == "email", F.lower(match)).when(kind == "ip", match).when(kind == "phone", national) \
        .when(kind == "name", F.concat_ws("|", gender, script, F.lower(first))).otherwise(digits(match))


def drawn(key: str, kind: Column, entity: Column, attempt: Column, salt: str = "") -> Column:
    """128 hexadecimal digits from the key, the kind, the entity and the attempt."""
    said = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"), F.lit(salt))
    return F.concat(F.sha2(said.cast("binary"), 256), F.sha2(F.concat(F.lit(key), F.sha2(said.cast("binary"), 256)).cast("binary"), 256))


def number_at(pool: Column, i: Column, below: Column | int) -> Column:
    """The i-th number of a pool, under ``below``: three hexadecimal digits each, the pool read round."""
    return F.conv(F.substring(F.concat(pool, pool), (i * 3) % 126 + 1, F.lit(3)), 16, 10).cast("int") % below


def like_for_like(x: Column, pool: Column) -> Column:
    """Each letter of ``x`` another letter, each digit another digit, all else as it is."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.when(i == 0, number_at(pool, i, 9) + 1).otherwise(number_at(pool, i, 10)).cast("string")).when(
        c.rlike("[a-z]"), F.substring(letters, number_at(pool, i, 26) + 1, F.lit(1))).otherwise(c)), "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a string of digits, the last digit counted once."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), worth), F.lit(0), lambda a, v: a + v)


def with_check_digit(number: Column) -> Column:
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def added(attempt: Column) -> Column:
    """1 to ``attempt``, or nothing: what is added to a draw, so that the space of draws grows until all entities fit."""
    return F.slice(F.sequence(F.lit(0), attempt), F.lit(2), F.greatest(attempt, F.lit(1)))


def made_name(entity: Column, pool: Column, attempt: Column) -> Column:
    """As many made-up words as the name has, in its script, ending as its gender does, a syllable longer with each attempt."""
    head, script, name = (F.get(F.split(entity, r"\|"), F.lit(i)) for i in range(3))

    def word(i: Column) -> Column:
        out = None
        for (s, g), ends in ENDINGS.items():
            parts = F.array(*[F.lit(x) for x in SYLLABLES[s]])
            said = F.concat(F.get(parts, number_at(pool, i * 4, 16)), F.get(parts, number_at(pool, i * 4 + 1, 16)),
                            F.get(parts, number_at(pool, i * 4 + 2, 16)),
                            F.array_join(F.transform(added(attempt), lambda k: F.get(parts, number_at(pool, i * 4 + k + 8, 16))), ""), F.get(F.array(*[F.lit(x) for x in ends]), number_at(pool, i * 4 + 3, 2)))
            test = (script == s) & (head == g)
            out = F.when(test, said) if out is None else out.when(test, said)
        return out

    return F.concat_ws("|", head, script, F.array_join(F.transform(F.split(name, " "), lambda _, i: word(i)), " "))


def surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """One draw. An email's domain draws alone, so that addresses of one domain stay together; its last label stays."""
    pool = drawn(key, kind, entity, attempt)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    last = F.substring_index(domain, ".", -1)
    hosts = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    more = F.array_join(F.transform(added(attempt), lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), number_at(pool, k + 20, 26) + 1, F.lit(1))), "")
    email = F.concat(like_for_like(local, pool), more, F.lit("@"), like_for_like(hosts, drawn(key, F.lit("domain"), domain, F.lit(0))), F.lit("."), last)
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: (number_at(pool, i, 254) + 1).cast("string")), ".")
    plain = like_for_like(entity, pool)
    card = F.when(luhn_sum(entity) % 10 == 0, with_check_digit(plain)).otherwise(plain)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "name", made_name(entity, pool, attempt)).otherwise(plain)


def surrogate_table(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """Written table (kind, entity, surrogate), distinct per kind and never an entity of the corpus. ``entities`` is a
    written table of distinct (kind, entity). Each round is two anti-joins and one combining aggregate of what is left."""
    taken, pending = None, entities
    for attempt in range(most_rounds):
        drawn_now = pending.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("entity"), F.lit(attempt)))
        first = drawn_now.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        free = first.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        free = written(free.select("kind", "entity", "surrogate"), "surrogates")
        taken = free if taken is None else taken.unionByName(free)
        pending = written(pending.join(free, ["kind", "entity"], "left_anti"), "pending")
        if not pending.limit(1).count():
            return written(taken, "surrogates")
    raise RuntimeError("surrogates still collide: a kind has more entities than its formats allow")


def in_format(kind: Column, match: Column, value: Column) -> Column:
    """The surrogate as the occurrence was written: its separators, country prefix, case and title."""
    count = F.length(digits(match))
    prefix = F.substring(digits(match), F.lit(1), F.greatest(count - F.length(value), F.lit(0)))
    number = F.concat(prefix, value)
    chars = F.split(match, "")
    # The n-th digit of the occurrence is the n-th of the number: what stands before it in digits is its place.
    dressed = F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(number, F.length(digits(F.substring(match, F.lit(1), i))) + 1, F.lit(1))).otherwise(c)), "")
    local, grown = F.instr(match, "@") - 1, F.length(value) - F.length(match)
    own = lambda i: F.when(i < local, i).when(i >= local + grown, i - grown).otherwise(F.lit(-1))
    cased = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.get(chars, own(i)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    said = F.initcap(F.substring_index(value, "|", -1))
    name = F.regexp_replace(match, rf"^({TITLE}\.? ).*$", "$1")
    return F.when(kind == "email", cased).when(kind == "ip", value).when(kind == "name", F.concat(name, said)).otherwise(dressed)


def replace_entities(docs: DataFrame, key: str = "veilscan", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_entities, entities (kind:surrogate, in order, comma-joined) and the rewritten text for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    some = text_or_empty().rlike(GATE) & text_or_empty().rlike(ANY)
    hit = rows.where(some).select("doc_id", F.split("text", ANY, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("matches"))
    found = F.transform("matches", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match")))
    held = written(hit.withColumn("rid", F.monotonically_increasing_id()).withColumn("found", found).drop("matches"), "entities")
    each = held.select("rid", F.posexplode("found").alias("at", "f")).select("rid", "at", "f.kind", "f.match") \
        .withColumn("entity", canonical(F.col("kind"), F.col("match")))
    each = written(each, "occurrences")
    table = surrogate_table(written(each.select("kind", "entity").distinct(), "distinct-entities"), key)
    placed = each.join(table, ["kind", "entity"]).withColumn("said", in_format(F.col("kind"), F.col("match"), F.col("surrogate")))
    lists = placed.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "said"))).alias("s"))
    joined = held.select("rid", "doc_id", "gaps").join(written(lists, "replacements"), "rid")
    body = F.array_join(F.zip_with("gaps", "s", lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s["said"], F.lit("")))), "")
    changed = joined.select("doc_id", F.size("s").cast("bigint").alias("n_entities"),
                            F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["kind"], s["said"])), ",").alias("entities"), body.alias("text"))
    same = rows.where(~some).select("doc_id", F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("entities"), "text")
    return changed.unionByName(same)
