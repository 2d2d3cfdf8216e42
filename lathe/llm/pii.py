"""PII: surrogate generation.

Entities are found by pattern and checked by form (a card number has to pass its
check digit).  Every distinct entity of the corpus gets one keyed replacement of
its own type, script, gender and format.  Proposals that meet another entity's
replacement, or a value that occurs in the corpus, are drawn again, so different
entities stay different and the same entity is the same everywhere.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spool, unwrap, wrap

# Titles that introduce a name, and given names by script and gender.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
GIVEN = {
    ("latin", "m"): ("Adrian", "Bernard", "Conrad", "Damian", "Edgar", "Felix", "Gordon", "Hector", "Ivan", "Julian", "Lucas", "Martin", "Norman", "Oscar", "Peter", "Roland", "Simon", "Thomas", "Victor", "Walter"),
    ("latin", "f"): ("Adele", "Beatrice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sonia", "Teresa", "Vera", "Wilma"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Григорий", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"),
}
# Parts that surnames are put together from.
SURNAME = {
    "latin": (("Ash", "Bram", "Cald", "Dun", "Ever", "Fair", "Grant", "Hol", "Kings", "Lang", "Mar", "North", "Oak", "Pres", "Stan", "Thorn"), ("berg", "bury", "combe", "dale", "field", "ford", "ham", "ley", "man", "mond", "son", "stein", "ton", "well", "wick", "wood")),
    "cyrillic": (("Бел", "Волк", "Горш", "Добр", "Ерм", "Зим", "Крыл", "Лавр"), ("ов", "ин", "енко", "ский", "ев", "ых", "ук", "ич")),
    "greek": (("Παπα", "Αλεξ", "Καρα", "Νικο", "Σταυρ", "Θεοδ"), ("όπουλος", "άκης", "ίδης", "ιάδης", "έας", "όγλου")),
}

_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES))
_INITIALS = "".join(sorted({t[0] for t in (*MALE_TITLES, *FEMALE_TITLES)}))
#: Each alternative begins where a run begins, so that long runs cost one attempt, and those of numbers and names look at one character first.
PATTERN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    r"|(?=[0-9+(])(?:(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
    r"|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
    r"|(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9]))"
    rf"|(?=[{_INITIALS}])(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{Ll}}'-]+(?: \p{{Lu}}[\p{{Ll}}'-]+)?"
)
#: What every number that PATTERN finds has in it.
SOME_NUMBER = r"[0-9][ .)-]*[0-9]"
#: Draws in the plain format, after which numbers grow, and after which something is wrong.
PLAIN, MOST = 8, 64
ENTITY = "struct<type:string,canon:string>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values) -> str:
    return f"array({','.join(map(_quoted, values))})"


def _luhn_sum(digits: str, shift: int) -> str:
    """Check sum; shift 0 if the check digit is there, 1 if it is still to come."""
    d = f"cast(substr(reverse({digits}), i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if((i + {shift}) % 2 = 1, {d}, 2 * {d} - if({d} > 4, 9, 0)))"


def entities_sql(m: str) -> str:
    """The entities of a match: one, or given name and surname; none if its form fails."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    one = lambda kind, canon: f"array(named_struct('type', {kind}, 'canon', {canon}))"
    names = f"slice(split({m}, ' '), 2, 2)"
    script = f"(case when {m} rlike '\\\\p{{IsCyrillic}}' then 'cyrillic' when {m} rlike '\\\\p{{IsGreek}}' then 'greek' else 'latin' end)"
    gender = f"if(array_contains({_array(MALE_TITLES)}, replace(split({m}, ' ')[0], '.', '')), 'm', 'f')"
    return (
        f"(case when instr({m}, '@') > 0 then {one(_quoted('email'), f'lower({m})')} "
        f"when {m} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then {one(_quoted('ip'), m)} "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {one(_quoted('ssn'), digits)} "
        f"when {m} rlike '^\\\\p{{L}}' then if(size({names}) = 2, "
        f"array(named_struct('type', concat('given:', {script}, ':', {gender}), 'canon', lower({names}[0])), named_struct('type', concat('surname:', {script}), 'canon', lower({names}[1]))), "
        f"array(named_struct('type', concat('surname:', {script}), 'canon', lower({names}[0])))) "
        f"when {m} rlike '^[0-9]{{4}}' then if({_luhn_sum(digits, 0)} % 10 = 0, {one(_quoted('card'), digits)}, cast(array() as array<{ENTITY}>)) "
        f"else {one(_quoted('phone'), digits)} end)"
    )


def may_hold(text: Column) -> Column:
    """A quick test that every text with a match of PATTERN passes."""
    out = text.contains("@") | text.rlike(SOME_NUMBER)
    for title in (*MALE_TITLES, *FEMALE_TITLES):
        out = out | text.contains(title)
    return F.coalesce(out, F.lit(False))


def pads(spark: SparkSession, key: str) -> DataFrame:
    """The keyed pads of HMAC-SHA-512 as one row, so that the key stands in no plan."""
    raw = key.encode()
    raw = (raw if len(raw) <= 128 else hashlib.sha512(raw).digest()).ljust(128, b"\0")
    return spark.createDataFrame([(bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw))], "inner binary, outer binary")


def surrogate_sql() -> str:
    """A proposal for (type, canon, attempt), of the entity's own format, from the keyed hash ``h`` in hex."""

    def byte(i: str) -> str:
        return f"cast(conv(substr(h, pmod(2 * ({i}), 126) + 1, 2), 16, 10) as int)"

    def number(i: str) -> str:
        return f"cast(conv(substr(h, pmod(7 * ({i}), 120) + 1, 8), 16, 10) as bigint)"

    digit = f"cast({byte('i')} % 10 as string)"
    # after PLAIN draws a number gets more digits with every draw, so that the draws come to an end
    more = f"greatest(0, attempt - {PLAIN - 1})"
    extra = f"if(attempt < {PLAIN}, '', array_join(transform(sequence(1, {more}), j -> transform(array(j + length(canon)), i -> {digit})[0]), ''))"
    # the last label of an address stays; from the fourth attempt on a short local part grows
    email = (
        f"concat(if(attempt >= 4, substr(h, 1, attempt), ''), array_join(transform(split(canon, ''), (c, i) -> case when i >= length(canon) - length(substring_index(canon, '.', -1)) then c "
        f"when c rlike '[0-9]' then {digit} when c rlike '[a-z]' then char(97 + {byte('i')} % 26) else c end), ''))"
    )
    ip = f"concat(array_join(transform(sequence(0, 3), i -> cast(1 + {byte('i')} % 254 as string)), '.'), if(attempt < {PLAIN}, '', concat('.', {extra})))"
    ssn = f"concat(array_join(transform(sequence(1, length(canon)), i -> {digit}), ''), {extra})"
    phone = f"concat(array_join(transform(split(canon, ''), (c, i) -> case when i < length(canon) - 10 then c when i = length(canon) - 10 then cast(2 + {byte('i')} % 8 as string) else {digit} end), ''), {extra})"
    body = f"concat(substr(canon, 1, 1), array_join(transform(sequence(2, length(canon) - 1), i -> {digit}), ''), {extra})"
    card = f"transform(array({body}), b -> concat(b, cast((10 - {_luhn_sum('b', 1)} % 10) % 10 as string)))[0]"
    cases = [f"when type = 'email' then {email}", f"when type = 'ip' then {ip}", f"when type = 'ssn' then {ssn}", f"when type = 'phone' then {phone}", f"when type = 'card' then {card}"]
    for (script, gender), names in GIVEN.items():
        part = f"{_array(names)}[cast({number('i')} % {len(names)} as int)]"
        cases.append(f"when type = 'given:{script}:{gender}' then array_join(transform(sequence(0, cast(attempt / 2 as int)), i -> {part}), '-')")
    for script, (first, last) in SURNAME.items():
        part = f"concat({_array(first)}[cast({number('i')} % {len(first)} as int)], {_array(last)}[cast({number('i + 5')} % {len(last)} as int)])"
        cases.append(f"when type = 'surname:{script}' then array_join(transform(sequence(0, cast(attempt / 2 as int)), i -> {part}), '-')")
    return f"case {' '.join(cases)} end"


def proposed(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, attempt) with the keyed hash as ``h`` and the proposal as ``sur``."""
    both = pads(entities.sparkSession, key)
    message = F.encode(F.concat_ws("|", "type", "canon", F.col("attempt").cast("string")), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(both.select("inner").scalar(), message), 512))
    return entities.withColumn("h", F.sha2(F.concat(both.select("outer").scalar(), inner), 512)).withColumn("sur", F.expr(surrogate_sql()))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """One replacement for every distinct (type, canon).

    Round by round: of the entities that propose the same replacement the smallest
    keeps it; the others, and those that propose a value kept before or one that is
    an entity itself, draw again.  Names grow with the draws, addresses and numbers after some, so that the rounds end.
    """
    keep = Scratch(entities.sparkSession)
    known = keep(entities.select("type", "canon").distinct())
    open_, kept = known.withColumn("attempt", F.lit(0)), None
    for _ in range(MOST):
        asked = keep(proposed(open_, key).select("type", "canon", "attempt", "sur"))
        winners = asked.groupBy("type", "sur").agg(F.min("canon").alias("canon"))
        taken = known.select("type", F.col("canon").alias("sur"))
        free = winners.join(taken, [winners["type"] == taken["type"], F.lower(winners["sur"]) == taken["sur"]], "left_anti")
        if kept is not None:
            free = free.join(kept.select("type", "sur"), ["type", "sur"], "left_anti")
        free = keep(free.select("type", "canon", "sur"))
        kept = free if kept is None else kept.unionByName(free)
        open_ = keep(asked.join(free.select("type", "canon"), ["type", "canon"], "left_anti").select("type", "canon", (F.col("attempt") + 1).alias("attempt")))
        if open_.isEmpty():
            out = spool(kept)
            keep.clear()
            return out
    raise RuntimeError(f"entities without a surrogate of their own after {MOST} draws")


def render_sql(m: str, sur: str) -> str:
    """A match with its entities' replacements (map from type|canon) in the format of the match."""
    ents = f"transform({entities_sql(m)}, e -> {sur}[concat(e.type, '|', e.canon)])"
    filled = (
        f"aggregate(split({m}, ''), named_struct('s', '', 'k', 1), (a, c) -> if(c rlike '[0-9]', named_struct('s', concat(a.s, substr(v[0], a.k, 1)), 'k', a.k + 1), "
        f"named_struct('s', concat(a.s, c), 'k', a.k)), a -> concat(a.s, substr(v[0], a.k)))"
    )
    return (
        f"transform(array({ents}), v -> case when size(v) = 0 or exists(v, y -> y is null) then {m} when instr({m}, '@') > 0 or {m} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then v[0] "
        f"when {m} rlike '^\\\\p{{L}}' then concat(split({m}, ' ')[0], ' ', array_join(v, ' ')) else {filled} end)[0]"
    )


#: The key of the queries and the pipeline where spark.lathe.pii.key names none: it is public, so their surrogates hide nothing from who reads this.
PUBLIC_KEY = "lathe"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.lathe.pii.key", PUBLIC_KEY)


def replace_pii(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """Replace every entity by its surrogate, which the secret ``key`` decides.

    The columns of docs stay, with the new text; ``count`` (occurrences replaced) is added, or
    takes the place of a column of that name, unless it is None.
    Null and empty texts pass unchanged with 0; repeated rows repeat; the same entity has
    the same surrogate in all rows; texts of any length are searched whole; an empty table stays empty.
    Texts without a match are never shuffled; texts with one meet their surrogates by hash.
    """
    rows = wrap(docs, text)
    matched = may_hold(F.col("_t")) & F.col("_t").rlike(PATTERN)
    found = F.regexp_extract_all(F.col("_t"), F.lit(PATTERN), F.lit(0))
    lists = rows.select("_t").where(matched).select(F.xxhash64("_t").alias("h"), found.alias("m"))
    keep = Scratch(docs.sparkSession)
    # texts with the same hash are the same row here, so copies count once
    per_text = keep(lists.select("h", F.explode(F.expr(f"array_distinct(flatten(transform(m, x -> {entities_sql('x')})))")).alias("e")).distinct())
    mapping = surrogates(per_text.select("e.type", "e.canon"), key)
    named = per_text.select("h", F.col("e.type").alias("type"), F.col("e.canon").alias("canon")).join(mapping, ["type", "canon"])
    # written, so that a text which a third of the rows share is split in the join
    maps = spool(named.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "canon"), "sur"))).alias("_sur")))
    keep.clear()
    joined = rows.where(matched).withColumn("_h", F.xxhash64("_t")).join(maps.withColumnRenamed("h", "_h"), "_h", "left")
    split = joined.withColumn("_m", F.when(F.col("_sur").isNotNull(), found))
    new = split.withColumn("_r", F.expr(f"transform(_m, x -> {render_sql('x', '_sur')})"))
    parts = F.split(F.col("_t"), PATTERN, -1)
    put = F.array_join(F.zip_with(parts, F.concat("_r", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.coalesce(F.expr("size(filter(zip_with(_m, _r, (a, b) -> a != b), y -> y))"), F.lit(0)).cast("bigint")
    known = F.col("_m").isNotNull()
    more = {count: F.when(known, n).otherwise(0).cast("bigint")} if count else {}
    replaced = unwrap(new, docs.columns, text, F.when(known, put).otherwise(F.col("_t")), **more)
    plain = unwrap(rows.where(~F.coalesce(matched, F.lit(False))), docs.columns, text, F.col("_t"), **{c: F.lit(0).cast("bigint") for c in more})
    return plain.unionByName(replaced)
