"""Personal data: detection and keyed surrogates (operator 3), with DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, IPv4 addresses, card numbers,
IBANs, social security numbers, secrets (long hexadecimal strings and access
keys) and titled personal names.  Each mention is reduced to its entity, a kind
and a canonical form (an address in lower case, the digits of a number, a name's
family part; a given name with its family name is an entity of its own, ``given``), so all
mentions of an entity, in any document and any notation, get
one surrogate (coreference).

A surrogate is drawn from the canonical form alone, by SHA-256 of the key, kind,
canonical form and attempt. Then it is written in the notation of the mention, from
which its canonical form can be read again: separators and letter case stay,
digits replace digits, letters replace letters, card numbers keep whether their
check digit is right, a phone number keeps its country code, an IPv4 address
stays one, names keep gender (by title) and script.

Collision checks: over the distinct entities of the whole corpus, no two may get
one surrogate, and none may get the canonical form of another real entity.  The
losers (all but the smallest of those that collide) draw again with the next
attempt until nobody collides.  Entities at attempt 0 need no lookup, so texts
are rewritten in place; only if some entities drew again are their attempts
joined to the documents that mention them (broadcast while they are few).

Cases: null and empty texts stay as they are; repeated rows each get the same
text; an empty table gives an empty one; all other columns are kept as they are,
whatever their names; texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import UPPER, free_name, materialise

KEY = "surrogate-key-1"
BROADCAST_MAPS = 50_000
_IP = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES_M = ("Mr.", "Mr", "Herr", "Señor", "господин")
_TITLES_F = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Señora", "госпожа")
_TITLE = "|".join(x.replace(".", r"\.") for x in sorted(_TITLES_M + _TITLES_F, key=len, reverse=True))
#: The kinds, in the order in which they are tried at a place.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
     r"(?:(?:\.[A-Za-z0-9\-]++)++(?<=\.[A-Za-z]{2,63})|(?:\.[A-Za-z0-9\-]+){0,126}\.[A-Za-z]{2,})"),  # without recursion on long hosts
    ("secret", r"(?<![\p{L}\p{N}])(?:(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|pat)[\-_][A-Za-z0-9]{20,64})(?![\p{L}\p{N}])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("phone", r"(?<![\p{L}\p{N}])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)"),
    ("ipv4", rf"(?<![\d.]){_IP}(?:\.{_IP}){{3}}(?!\d|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"),
    ("name", rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}) \p{{Lu}}[\p{{Ll}}'\-]+(?: \p{{Lu}}[\p{{Ll}}\-]+)?(?!\p{{L}})"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Country codes of one and two digits; all others have three.
COUNTRY_CODES = ("^[+][17]", "^[+](2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
#: Letters of addresses by script, in lower case where there is one and without any that changes with its place; Latin for all others.
ALPHABETS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνοπρτυφχψω", "Armenian": "աբգդեզէըթժիլխծկհձ",
    "Hebrew": "אבגדהוזחטילמנסעפקרשת", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशसह",
    "Thai": "กขคงจฉชซดตถทนบปผพฟมยรลวสหอ", "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조", "Hiragana": "あいうえおかきくけこさしすせそたちつてと",
    "Katakana": "アイウエオカキクケコサシスセソタチツテト", "Han": "一丁七万三上下中丸主久之九也二云五井人今",
}
#: Given names by gender and script; family names are built of syllables.
GIVEN = {
    ("f", "latin"): "Ada Anna Clara Diana Elena Emma Greta Ida Ines Julia Laura Lena Maria Marta Nina Olga Paula Rosa Sara Vera".split(),
    ("m", "latin"): "Adam Alan Boris Carl David Emil Erik Felix Hugo Ivan Jan Karl Leo Marc Noel Oscar Paul Peter Tom Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Олег Павел Пётр Сергей Фёдор Юрий".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we za".split(),
    "cyrillic": "ба бе бо ва ве во га да де до за ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то ха".split(),
}


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words) -> str:
    return "array(" + ",".join(map(_q, words)) + ")"


def mentions(text: str) -> str:
    """SQL: all mentions in order (empty for null)."""
    return f"regexp_extract_all(coalesce({text}, ''), {_q(PATTERN)}, 0)"


def _kind(m: str) -> str:
    return f"""case when instr({m}, '@') > 0 then 'email'
        when {m} rlike '^(?:{_TITLE}) ' then 'name'
        when {m} rlike '^[+(]' then 'phone'
        when {m} rlike '^[0-9.]+$' and instr({m}, '.') > 0 then 'ipv4'
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
        when {m} rlike '^[0-9 -]+$' and length(replace(replace({m}, ' ', ''), '-', '')) < 20 then 'card'
        when {m} rlike '^[A-Z]{{2}}[0-9]{{2}}' and not {m} rlike '^[0-9A-Fa-f]{{32,}}$' then 'iban'
        else 'secret' end"""


def _canonical(kind: str, m: str) -> str:
    """A name stands for its family name; gender and script are part of the form."""
    return f"""case {kind} when 'email' then {_lower(m)} when 'ipv4' then {m} when 'secret' then lower({m})
        when 'name' then concat({_gender(m)}, {_script(m)}, lower(substring_index({m}, ' ', -1)))
        when 'iban' then upper(replace({m}, ' ', ''))
        when 'phone' then regexp_replace({m}, '[^0-9+]', '')
        else regexp_replace({m}, '[^0-9]', '') end"""


def _lower(m: str) -> str:
    """Lower case, one character for each, wherever it stands."""
    return f"translate(lower(translate({m}, 'İ', 'i')), 'ς', 'σ')"


def _gender(m: str) -> str:
    return f"if({m} rlike '^(?:{'|'.join(t.replace('.', '[.]') for t in sorted(_TITLES_M, key=len, reverse=True))}) ', 'm', 'f')"


def _script(m: str) -> str:
    return f"if(substring_index({m}, ' ', -1) rlike '^[\\\\u0400-\\\\u04FF]', 'c', 'l')"


def _digest(kind: str, canon: str, attempt: str) -> str:
    """128 hexadecimal digits that only the key's holder can repeat."""
    seed = f"concat_ws('\\u0001', {_q(KEY)}, {kind}, {canon}, string({attempt}))"
    return f"concat(sha2({seed}, 256), sha2(concat({seed}, '+'), 256))"


def _nth(d: str, i: str, n: int) -> str:
    """A number below ``n`` from digit pair ``i`` of the digest."""
    return f"int(conv(substring({d}, 1 + 2 * pmod({i}, 63), 3), 16, 10) % {n})"


def _other(c: str, d: str, alphabet: str) -> str:
    """A character of ``alphabet`` that isn't ``c``, from place ``i`` of the digest."""
    n = len(alphabet)
    return f"substring('{alphabet}', 1 + (instr('{alphabet}', {c}) + {_nth(d, 'i', n - 1)}) % {n}, 1)"


def _same_shape(m: str, d: str) -> str:
    """Digits for digits and letters for letters of the same script and case, all else kept; no letter or digit stays."""
    scripts = " ".join(f"when c rlike '[\\\\p{{Is{s}}}&&\\\\p{{L}}]' then {_other('c', d, a)}" for s, a in ALPHABETS.items())
    return f"""array_join(transform(split({m}, ''), (c, i) -> case
        when c between 'a' and 'z' then {_other('c', d, UPPER.lower())}
        when c between '0' and '9' then {_other('c', d, '0123456789')}
        when c between 'A' and 'Z' then {_other('c', d, UPPER)}
        when c < '\\u0080' then c
        when c rlike '\\\\p{{N}}' then {_other('c', d, '0123456789')}
        {scripts}
        when c rlike '\\\\p{{L}}' then {_other('c', d, UPPER.lower())}
        else c end), '')"""


def _cased(m: str, s: str) -> str:
    """``s`` with capitals where ``m`` has them."""
    return f"""array_join(transform(split({m}, ''), (c, i) -> if(c = lower(c), substring({s}, i + 1, 1), upper(substring({s}, i + 1, 1)))), '')"""


def _into(m: str, chars: str, places: str = "[0-9]") -> str:
    """``chars`` in the places that hold the digits (or other ``places``) of ``m``."""
    return f"""aggregate(split({m}, ''), struct('' as s, 1 as k), (acc, c) -> if(c rlike '{places}',
        struct(concat(acc.s, substring({chars}, acc.k, 1)) as s, acc.k + 1 as k),
        struct(concat(acc.s, c) as s, acc.k as k)), acc -> acc.s)"""


def _luhn(digits: str) -> str:
    """Sum of the Luhn test."""
    return f"""aggregate(transform(reverse(split({digits}, '')), (c, i) -> if(i % 2 = 1,
        if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (s, x) -> s + x)"""


def _number(canon: str, d: str, skip: str = "0") -> str:
    return f"""concat(substring({canon}, 1, {skip}), array_join(transform(sequence(1, length({canon}) - {skip}),
        i -> string({_nth(d, 'i', 10)})), ''))"""


def _card(canon: str, d: str) -> str:
    body = f"substring({_number(canon, d)}, 1, length({canon}) - 1)"
    check = f"string((10 - {_luhn(f'''concat({body}, '0')''')} % 10) % 10)"
    return f"if({_luhn(canon)} % 10 = 0, concat({body}, {check}), {_number(canon, d)})"


def _ipv4(d: str) -> str:
    return "concat_ws('.', " + ", ".join(f"string({_nth(d, str(k), n)} + {a})" for k, (n, a) in enumerate([(223, 1), (256, 0), (256, 0), (254, 1)])) + ")"


def _email(canon: str, d: str) -> str:
    """The local part keeps its shape; the host is one of a domain kept for examples."""
    local = f"substring_index({canon}, '@', 1)"
    return f"concat({_same_shape(local, d)}, '@m', substring({d}, 101, 12), '.example.net')"


def _family(canon: str, d: str, attempt: str) -> str:
    """The surrogate of a family name, with gender and script before it."""
    def family(script: str) -> str:
        syllable = f"element_at({_array(SYLLABLES[script])}, 1 + {_nth(d, '7 * i', len(SYLLABLES[script]))})"
        return f"array_join(transform(sequence(1, 3 + {attempt}), i -> {syllable}), '')"

    return f"concat(substring({canon}, 1, 2), if(substring({canon}, 2, 1) = 'c', {family('cyrillic')}, {family('latin')}))"


def _given_canonical(m: str, canon: str) -> str:
    """The entity of a full name, a bare family name has none (null)."""
    return f"if(size(split({m}, ' ')) > 2, concat({canon}, ' ', lower(split({m}, ' ')[1])), null)"


def _given(canon: str, d: str, attempt: str) -> str:
    """Another given name for the bearers of a family name: a common one, with a syllable more by each attempt."""
    def given(gender: str, script: str) -> str:
        syllable = f"element_at({_array(SYLLABLES[script])}, 1 + {_nth(d, '7 * i', len(SYLLABLES[script]))})"
        first = f"lower(element_at({_array(GIVEN[gender, script])}, 1 + {_nth(d, '5', len(GIVEN[gender, script]))}))"
        return f"concat({first}, array_join(transform(slice(sequence(0, {attempt}), 2, {attempt}), i -> {syllable}), ''))"

    by = " ".join(f"when {canon} like '{g}{x[0]}%' then {given(g, x)}" for g, x in GIVEN)
    return f"concat(substring_index({canon}, ' ', 1), ' ', case {by} end)"


def _name(m: str, family: str, given: str) -> str:
    return f"concat_ws(' ', substring_index({m}, ' ', 1), initcap(substring_index({given}, ' ', -1)), initcap(substring({family}, 3)))"


def _drawn(kind: str, canon: str, d: str, attempt: str) -> str:
    """SQL: the canonical form of an entity's surrogate."""
    skip = f"if({canon} like '+%', case when {canon} rlike '{COUNTRY_CODES[0]}' then 2 when {canon} rlike '{COUNTRY_CODES[1]}' then 3 else 4 end, 0)"
    return f"""case {kind} when 'email' then {_email(canon, d)} when 'ipv4' then {_ipv4(d)}
        when 'secret' then if({canon} rlike '^[0-9a-f]+$', substring({d}, 1, length({canon})), {_same_shape(canon, d)})
        when 'iban' then concat(substring({canon}, 1, 2), {_same_shape(f"substring({canon}, 3)", d)})
        when 'phone' then {_number(canon, d, skip)}
        when 'card' then {_card(canon, d)}
        when 'name' then {_family(canon, d, attempt)}
        when 'given' then {_given(canon, d, attempt)}
        else {_number(canon, d)} end"""


def _written(m: str, kind: str, s: str, given: str) -> str:
    """SQL: the surrogate of canonical form ``s`` in the notation of mention ``m``; ``given``: that of a full name, or null."""
    host = f"substring_index({s}, '@', -1)"
    return f"""case {kind} when 'email' then concat({_cased(f"substring_index({m}, '@', 1)", s)}, '@', if({m} = upper({m}), upper({host}), {host}))
        when 'ipv4' then {s}
        when 'secret' then if({m} rlike '^[0-9A-Fa-f]+$', if({m} rlike '[a-f]', {s}, upper({s})), {_cased(m, s)})
        when 'iban' then {_into(m, s, '[0-9A-Z]')}
        when 'phone' then {_into(m, s, '[0-9+]')}
        when 'name' then {_name(m, s, given)}
        else {_into(m, s)} end"""


def surrogates(array: str, attempts: str | None = None) -> str:
    """SQL: the surrogates of an array of mentions; ``attempts``: a map from kind, blank and mention."""
    def attempt(kind: str) -> str:
        return f"coalesce(try_element_at({attempts}, concat({kind}, ' ', x.m)), 0)" if attempts else "0"

    x = f"transform({array}, m -> struct(m as m, {_kind('m')} as k))"
    x = f"transform({x}, x -> struct(x.m as m, x.k as k, {_canonical('x.k', 'x.m')} as c, {attempt('x.k')} as a))"
    x = f"""transform({x}, x -> struct(x.m as m, x.k as k, x.c as c, x.a as a, {_digest('x.k', 'x.c', 'x.a')} as d,
        if(x.k = 'name', {_given_canonical('x.m', 'x.c')}, null) as gc, if(x.k = 'name', {attempt("'given'")}, 0) as ga))"""
    given = f"element_at(transform(array({_digest(_q('given'), 'x.gc', 'x.ga')}), gd -> {_given('x.gc', 'gd', 'x.ga')}), 1)"
    x = f"transform({x}, x -> struct(x.m as m, x.k as k, {_drawn('x.k', 'x.c', 'x.d', 'x.a')} as s, if(x.gc is null, null, {given}) as g))"
    return f"transform({x}, x -> {_written('x.m', 'x.k', 'x.s', 'x.g')})"


def _entities(ms: DataFrame, *cols: str) -> DataFrame:
    """``(*cols, kind, canon, m)`` of the mentions ``ms(*cols, m)``; a full name is two entities."""
    x = ms.select(*cols, F.expr(_kind("m")).alias("kind"), "m").select(*cols, "kind", F.expr(_canonical("kind", "m")).alias("canon"), "m")
    x = x.withColumn("full", F.expr(f"if(kind = 'name', {_given_canonical('m', 'canon')}, null)"))
    return x.select(*cols, "m", F.expr("inline(if(full is null, array(struct(kind, canon)), array(struct(kind, canon), struct('given' as kind, full as canon))))"))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, canon)``: distinct entities of all documents."""
    m = docs.select(F.explode_outer(F.expr(mentions(f"`{text}`"))).alias("m")).where("m is not null") \
        .groupBy("m").agg(F.lit(1).alias("one"))
    return _entities(m).select("kind", "canon").distinct()


def _reduced(df: DataFrame) -> DataFrame:
    """Adds ``sur``, the canonical form of each entity's surrogate at its attempt."""
    d = df.withColumn("d", F.expr(_digest("kind", "canon", "attempt")))
    return d.withColumn("sur", F.expr(_drawn("kind", "canon", "d", "attempt"))).drop("d")


def attempts(ents: DataFrame) -> DataFrame | None:
    """``(kind, canon, attempt)`` of the entities that had to draw again; None if there are none."""
    real = ents.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("real"))
    state = materialise(_reduced(ents.withColumn("attempt", F.lit(0))))
    while True:
        first = state.groupBy("kind", "sur").agg(F.min("canon").alias("winner"))
        lost = state.join(first, ["kind", "sur"]).join(real, ["kind", "sur"], "left") \
            .withColumn("lost", (F.col("canon") != F.col("winner")) | F.coalesce("real", F.lit(False)))
        lost = materialise(lost.select("kind", "canon", "attempt", "sur", "lost"))
        if not lost.where("lost").limit(1).count():
            break
        again = _reduced(lost.where("lost").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        state = materialise(lost.where("not lost").select("kind", "canon", "attempt", "sur").unionByName(again))
    drawn = state.where("attempt > 0").select("kind", "canon", "attempt")
    return drawn if drawn.limit(1).count() else None


def replace_entities(docs: DataFrame, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with every mention in ``text`` replaced; ``found`` names an added column with the kinds, in order."""
    ents = materialise(entities(docs, text))
    again = attempts(ents)
    t, m, a = (free_name(docs, x) for x in ("pii_text", "pii_mentions", "pii_attempts"))
    d = docs.withColumn(m, F.expr(mentions(f"`{text}`")))
    if again is None:
        sur = F.expr(surrogates(f"`{m}`"))
    else:  # a map of the few entities of this row that drew again
        h = free_name(docs, "pii_hash")
        key = F.xxhash64(docs[text])
        each = docs.select(key.alias(h), F.explode_outer(F.expr(mentions(f"`{text}`"))).alias("m")).where("m is not null").distinct()
        maps = materialise(_entities(each, h).join(again, ["kind", "canon"]).groupBy(h).agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "m"), "attempt"))).alias(a)))
        if maps.count() <= BROADCAST_MAPS:
            maps = F.broadcast(maps)
        d = d.withColumn(h, F.xxhash64(text)).join(maps, h, "left").drop(h)
        sur = F.expr(surrogates(f"`{m}`", f"`{a}`"))
    pieces = F.split(F.col(text), PATTERN, -1)
    merged = F.array_join(F.zip_with(pieces, F.concat(sur, F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")
    d = d.withColumn(t, F.when(F.size(m) > 0, merged).otherwise(F.col(text)))
    kinds = [F.expr(f"transform(`{m}`, x -> {_kind('x')})").alias(found)] if found else []
    return d.select(*[F.col(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *kinds)
