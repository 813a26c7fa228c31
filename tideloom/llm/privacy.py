"""Surrogates for personal data, by DataFrame functions alone.

Entities found by patterns are replaced by surrogates of the same kind and format. A
surrogate is a keyed permutation of the entity: its last letter or digit is moved by an
amount other than zero that the key and all before it determine, and a Feistel network moves
what is before it, each character within its class (digits, vowels, consonants, by script).
So the same entity gets the same surrogate in every document, different entities of a kind
never share one, none is its own, and no table of names or texts has to be moved. A name that
a document has after a title is replaced wherever the document has it. ``clashes`` checks
distinctness over all documents.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, staged

KINDS = ("email", "phone", "ip", "ssn", "card", "person")
DEFAULT_KEY = "tideloom"
ROUNDS = 4

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа",
    "m": "Mr|Herr|Monsieur|Señor|Господин",
}
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[2-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}]|[.][0-9])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES['f']}|{_TITLES['m']})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?(?!\p{{L}})",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
_TITLED = rf"^((?:{_TITLES['f']}|{_TITLES['m']})\.?) "

_COMMON = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöøùúûüÿ", "çñðþß",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
# Blocks whose other letters, lower-case or without case, or digits stand for each other.
_BLOCKS = (
    (0x100, 0x250), (0x250, 0x2B0), (0x370, 0x400), (0x400, 0x530), (0x531, 0x590), (0x5D0, 0x5EB), (0x620, 0x64B), (0x660, 0x66A), (0x6F0, 0x6FA), (0x904, 0x93A),
    (0x966, 0x970), (0xE01, 0xE31), (0x10D0, 0x10FB), (0x1E00, 0x1F00), (0x1F00, 0x2000), (0x3041, 0x3097), (0x30A1, 0x30FB), (0xFF10, 0xFF1A),
)


def _members(low: int, high: int) -> str:
    """Letters of a block that keep their case and length, or its digits; those of the common classes apart."""
    held = "".join(_COMMON)
    plain = lambda c: unicodedata.category(c) in ("Lo", "Nd") or (unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper().lower() == c and c.upper() != c)
    return "".join(c for c in map(chr, range(low, high)) if plain(c) and c not in held)


_CLASSES = (*_COMMON, *(_members(*block) for block in _BLOCKS))
_CHANGED = r"[\p{L}\p{N}]"
_GIVEN = {
    ("f", "latin"): "Anna,Clara,Emma,Julia,Laura,Maria,Sophie,Teresa",
    ("m", "latin"): "Adam,Daniel,Felix,Jacob,Martin,Oscar,Paul,Victor",
    ("f", "cyrillic"): "Анна,Вера,Дарья,Елена,Ирина,Мария,Ольга,Софья",
    ("m", "cyrillic"): "Антон,Борис,Виктор,Денис,Иван,Максим,Павел,Сергей",
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _classed(word: str) -> str:
    """SQL for the characters of a word, each with its class: the letters it moves among, empty for those of no class, null for what stays."""
    cases = " ".join(f"WHEN instr('{letters}', c) > 0 THEN '{letters}'" for letters in _CLASSES if len(letters) > 1)
    kind = f"CASE {cases} WHEN c RLIKE {_text(_CHANGED)} THEN '' END"
    return f"transform(filter(split({word}, ''), x -> x <> ''), c -> named_struct('c', c, 'l', {kind}))"


def _moved(x: str, amount: str, apart: bool = False) -> str:
    """SQL for a classed character moved within its class; with ``apart``, never onto itself.

    Letters and digits of no class (ideographs, rare scripts) are moved among the 16 code points around them.
    """
    by = lambda size: f"1 + {amount} % ({size} - 1)" if apart else amount
    code = f"(ascii({x}.c) - ascii({x}.c) % 16 + (ascii({x}.c) % 16 + {by('16')}) % 16)"
    other = f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"
    own = f"substr({x}.l, (instr({x}.l, {x}.c) - 1 + {by(f'length({x}.l)')}) % length({x}.l) + 1, 1)"
    return f"named_struct('c', CASE WHEN {x}.l IS NULL THEN {x}.c WHEN {x}.l = '' THEN {other} ELSE {own} END, 'l', {x}.l)"


def _byte(digest: str, at: str) -> str:
    return f"cast(conv(substr({digest}, 1 + 2 * ({at} % 32), 2), 16, 10) AS int)"


def _spelled(chars: str) -> str:
    return f"array_join(transform({chars}, x -> x.c), '')"


def _shifted(chars: str, digest: str) -> str:
    return _let("dg", digest, f"transform({chars}, (x, i) -> {_moved('x', _byte('dg', 'i'))})")


def _permuted(word: str, tag: str, key: str) -> str:
    """SQL for the keyed permutation of a lower-case word; its classes of characters stay in place, and no word with a letter or digit stays."""
    digest = lambda what, half: f"sha2(concat({_text(key + '|')}, {tag}, '|', {what}, '|', {_spelled(half)}), 256)"
    start = "named_struct('a', slice(w, 1, size(w) div 2), 'b', slice(w, size(w) div 2 + 1, size(w) - size(w) div 2))"
    rounds = (
        f"IF(r % 2 = 0, named_struct('a', acc.a, 'b', {_shifted('acc.b', digest('cast(r AS string)', 'acc.a'))}), "
        f"named_struct('a', {_shifted('acc.a', digest('cast(r AS string)', 'acc.b'))}, 'b', acc.b))"
    )
    before = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (acc, r) -> {rounds}, acc -> concat({_spelled('acc.a')}, {_spelled('acc.b')}))"
    last = _let("y", "element_at(cs, lt)", f"{_moved('y', _byte(digest(repr('last'), 'w'), '0'), apart=True)}.c")
    run = f"IF(lt = 0, {_spelled('cs')}, concat({before}, {last}, {_spelled('slice(cs, lt + 1, size(cs) - lt)')}))"
    ends = "array_max(transform(cs, (x, i) -> IF(x.l IS NOT NULL, i + 1, 0)))"
    return _let("cs", _classed(word), _let("lt", f"coalesce({ends}, 0)", _let("w", "slice(cs, 1, greatest(lt - 1, 0))", run)))


def _low(text: str) -> str:
    """The text in lower case, but for characters whose case does not come back."""
    return f"array_join(transform(filter(split({text}, ''), x -> x <> ''), x -> IF(length(lower(x)) = 1 AND upper(lower(x)) = x, lower(x), x)), '')"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _laid_over(form: str, digits: str) -> str:
    """The digits put in the places of the digits of ``form``."""
    place = f"length({_digits('substr(fm, 1, i + 1)')})"
    return _let("fm", form, _let("nd", digits, f"array_join(transform(filter(split(fm, ''), x -> x <> ''), (c, i) -> IF(c BETWEEN '0' AND '9', substr(nd, {place}, 1), c)), '')"))


def _cased_like(form: str, word: str) -> str:
    cased = (
        "array_join(transform(sequence(1, length(fm)), i -> IF(length(lower(substr(fm, i, 1))) = 1 AND substr(fm, i, 1) <> lower(substr(fm, i, 1)) "
        "AND upper(lower(substr(fm, i, 1))) = substr(fm, i, 1) AND length(upper(substr(nw, i, 1))) = 1, upper(substr(nw, i, 1)), substr(nw, i, 1))), '')"
    )
    return _let("fm", form, _let("nw", word, cased))


def _check_digit(digits: str) -> str:
    """Luhn's check digit of the digits before it."""
    doubled = "(cast(c AS int) * IF((length(ld) - i) % 2 = 1, 2, 1))"
    total = f"aggregate(transform(filter(split(ld, ''), x -> x <> ''), (c, i) -> {doubled} div 10 + {doubled} % 10), 0L, (s, x) -> s + x)"
    return _let("ld", digits, f"(10 - {total} % 10) % 10")


_KIND = r"""CASE
    WHEN instr(m, '@') > 0 THEN 'email'
    WHEN m RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' THEN 'ip'
    WHEN m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'ssn'
    WHEN m RLIKE '^[+(]|^[0-9]{3}[.-][0-9]{3}[ .-][0-9]{4}$' THEN 'phone'
    WHEN m RLIKE '^[0-9]' THEN 'card'
    ELSE 'person' END"""


def _listed(name: str, key: str) -> str:
    """SQL for another given name of the same gender and script, or null for a name that is not listed."""
    cases = []
    for (gender, script), listed in _GIVEN.items():
        size = len(listed.split(","))
        turn = 1 + int(hashlib.sha256(f"{key}|given|{gender}|{script}".encode()).hexdigest()[:8], 16) % (size - 1)
        at = f"array_position(split('{listed}', ','), {name})"
        cases.append(f"WHEN {at} > 0 THEN split('{listed}', ',')[cast(({at} - 1 + {turn}) % {size} AS int)]")
    return f"CASE {' '.join(cases)} END"


def _surrogate(key: str) -> str:
    """SQL for ``struct<kind, same, other>`` of a match ``m`` in a document with the last names ``ls``: what identifies the entity, and its surrogate.

    The words of the entity that are permuted are put together first, so that there is one permutation for all kinds.
    """
    names = {
        "k": _KIND,
        "cc": r"IF(k = 'phone', regexp_extract(m, '^(?:\\+[0-9]{1,3}(?=[ .(-])|\\+(?:[17]|[2-9][0-9]))?', 0), '')",
        "en": "IF(k = 'email', regexp_extract(m, '[.][A-Za-z]+$', 0), '')",
        "hd": "substr(m, length(cc) + 1, length(m) - length(cc) - length(en))",
        # Both sides of an address are permuted by themselves, so that neither stays.
        "lc": "IF(k = 'email', substring_index(hd, '@', 1), '')",
        "dm": "substr(hd, length(lc) + 2)",
        "ds": _digits("hd"),
        "tt": f"IF(k = 'person', regexp_extract(m, {_text(_TITLED)}, 1), '')",
        "ns": "IF(tt = '', split(m, ' '), slice(split(m, ' '), 2, 2))",
        # One word without a title is a last name if the document has it as one, else a given name.
        "gn": "IF(k = 'person' AND (size(ns) = 2 OR (tt = '' AND NOT array_contains(ls, ns[0]))), ns[0], '')",
        "ln": "IF(k = 'person' AND (size(ns) = 2 OR tt <> '' OR array_contains(ls, ns[0])), element_at(ns, -1), '')",
    }
    part = lambda tag, word: f"named_struct('tag', '{tag}', 'word', {word})"
    parts = (
        f"CASE k WHEN 'email' THEN array({part('email', _low('lc'))}, {part('domain', _low('dm'))}) WHEN 'phone' THEN array({part('phone', 'ds')}) WHEN 'ssn' THEN array({part('ssn', 'ds')}) "
        f"WHEN 'card' THEN array({part('card', 'left(ds, length(ds) - 1)')}) WHEN 'person' THEN array({part('given', _low('gn'))}, {part('person', _low('ln'))}) "
        f"ELSE filter(array({part('', repr(''))}), p -> false) END"
    )
    moved = f"(cast(right(ds, 1) AS int) - {_check_digit('left(ds, length(ds) - 1)')} + 10)"
    card = _let("np", "pm[0]", f"concat(np, cast(({_check_digit('np')} + {moved}) % 10 AS string))")
    amount = lambda half: f"cast(conv(substr(sha2(concat({_text(key + '|ip|')}, cast(r AS string), '|', cast({half} AS string)), 256), 1, 8), 16, 10) AS bigint)"
    # The last octet is moved by 1 to 255, as the other three determine.
    final = f"(o[3] + 1 + cast(conv(substr(sha2(concat({_text(key + '|ip|last|')}, o[0], '.', o[1], '.', o[2]), 256), 1, 8), 16, 10) AS bigint) % 255) % 256"
    ip = _let(
        "o", "transform(split(m, '[.]'), x -> cast(x AS bigint))",
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', o[0] * 256 + o[1], 'b', o[2]), (acc, r) -> "
        f"IF(r % 2 = 0, named_struct('a', acc.a, 'b', (acc.b + {amount('acc.a')}) % 256), named_struct('a', (acc.a + {amount('acc.b')}) % 65536, 'b', acc.b)), "
        f"acc -> concat_ws('.', acc.a div 256, acc.a % 256, acc.b, {final}))",
    )
    # One laying out for all: the form that has the letters' case and the digits' places, and what is laid over it.
    first = f"coalesce({_listed('gn', key)}, {_cased_like('gn', 'pm[0]')})"
    person = f"concat_ws(' ', NULLIF(tt, ''), NULLIF({first}, ''), NULLIF({_cased_like('ln', 'pm[1]')}, ''))"
    laid = _laid_over("hd", f"IF(k = 'card', {card}, pm[0])")
    same = f"CASE k WHEN 'email' THEN {_low('m')} WHEN 'ip' THEN m WHEN 'person' THEN m ELSE concat(cc, ds) END"
    other = f"CASE k WHEN 'email' THEN concat({_cased_like('lc', 'pm[0]')}, '@', {_cased_like('dm', 'pm[1]')}, en) WHEN 'ip' THEN {ip} WHEN 'person' THEN {person} ELSE concat(cc, {laid}) END"
    body = _let("pm", f"transform({parts}, p -> {_permuted('p.word', 'p.tag', key)})", f"named_struct('kind', k, 'same', {same}, 'other', {other})")
    for name, value in reversed(names.items()):
        body = _let(name, value, body)
    return body


_FOUND = "struct<found:array<string>,gaps:array<string>,lasts:array<string>>"
#: Matches whose lengths are added up at once.
_CHUNK = 256


def _entities(text: str) -> str:
    """SQL for the entities of a text, the gaps around them, and the last names among them.

    Where there are names after titles, the text is read again for these names without one.
    """
    words = f"transform(filter(f1, m -> m RLIKE {_text(_TITLED)}), m -> slice(split(m, ' '), 2, 2))"
    lasts = "array_distinct(transform(wd, x -> element_at(x, -1)))"
    named = "array_distinct(concat(transform(filter(wd, x -> size(x) = 2), x -> array_join(x, ' ')), flatten(wd)))"
    wider = f"concat({_text(ANY + '|(?<!' + _CHANGED + ')(?:')}, array_join({named}, '|'), {_text(')(?!' + _CHANGED + ')')})"
    cut = lambda pattern, found: f"named_struct('found', {found}, 'gaps', split({text}, {pattern}, -1), 'lasts', ls)"
    again = _let("pt", wider, cut("pt", f"regexp_extract_all({text}, pt, 0)"))
    plain = f"IF(size(f1) = 0, named_struct('found', f1, 'gaps', array({text}), 'lasts', ls), {cut(_text(ANY), 'f1')})"
    whole = _let("wd", words, _let("ls", lasts, f"IF(size(wd) > 0, {again}, {plain})"))
    return f"IF({text} IS NULL, cast(NULL AS {_FOUND}), {_let('f1', f'regexp_extract_all({text}, {_text(ANY)}, 0)', whole)})"


def marked(docs: DataFrame, text: str = "text", into: str = "entities") -> tuple[DataFrame, str]:
    """``docs`` with its texts cut into entities and gaps, staged, and the column that has them in place of ``text``."""
    place = fresh_name(docs, "cut")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in (text, into)]
    return staged(docs.select(*columns, F.expr(_entities(f"cast(`{text}` AS string)")).alias(place)), "entities"), place


def _replaced(cut: DataFrame, place: str, order: list[str], key: str, text: str, into: str) -> DataFrame:
    """The texts put together again with surrogates."""
    new = fresh_name(cut, "new")
    made = cut.withColumn(new, F.expr(_let("ls", f"{place}.lasts", f"transform({place}.found, m -> {_surrogate(key)})")))
    # Ends of matches: what the chunks before add up to, and the own chunk up to the match.
    sizes = f"zip_with(slice({place}.gaps, 1, size({place}.found)), {place}.found, (g, f) -> cast(length(g) + length(f) AS bigint))"
    add = "(a, x) -> a + x"
    chunks = f"transform(sequence(0, (size(sz) - 1) div {_CHUNK}), i -> aggregate(slice(sz, i * {_CHUNK} + 1, {_CHUNK}), 0L, {add}))"
    heads = f"transform(sequence(0, size(ch) - 1), i -> IF(i = 0, 0L, aggregate(slice(ch, 1, i), 0L, {add})))"
    end = f"hs[i div {_CHUNK}] + aggregate(slice(sz, i div {_CHUNK} * {_CHUNK} + 1, i % {_CHUNK} + 1), 0L, {add})"
    ends = _let("sz", sizes, _let("ch", chunks, _let("hs", heads, f"transform(sz, (x, i) -> {end})")))
    span = f"named_struct('kind', x.kind, 'start', en[i] - length({place}.found[i]), 'end', en[i], 'other', x.other)"
    spans = _let("en", ends, f"transform({new}, (x, i) -> {span})")
    empty = "cast(array() AS array<struct<kind:string,start:bigint,end:bigint,other:string>>)"
    written = f"array_join(zip_with({place}.gaps, concat(transform({new}, x -> x.other), array('')), (g, s) -> concat(g, s)), '')"
    columns = [F.expr(f"IF(size({place}.found) > 0, {written}, {place}.gaps[0])").alias(c) if c == text else F.col(f"`{c}`") for c in order if c != into]
    return made.select(*columns, F.expr(f"CASE WHEN {place} IS NULL THEN NULL WHEN size({place}.found) = 0 THEN {empty} ELSE {spans} END").alias(into))


def with_surrogates(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", into: str = "entities") -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and the array ``into`` of ``kind, start, end, other``.

    Offsets are code points of the original text, end exclusive. Names are found after titles,
    and from there at all their places in the document. A null text stays null with a null
    array; a text without entities stays as it is with an empty array. Repeated rows get equal
    results. A column already named ``into`` is replaced; others stay, whatever their names.
    """
    cut, place = marked(docs, text, into)
    return _replaced(cut, place, docs.columns, key, text, into)


def _clashing(cut: DataFrame, place: str, key: str) -> DataFrame:
    # Each entity once; names without a title follow from those with one.
    own = F.explode(F.expr(f"filter({place}.found, m -> m RLIKE {_text(_TITLED)} OR m RLIKE '[0-9@]')"))
    found = cut.where(F.expr(f"size({place}.found) > 0")).select(own.alias("m")).distinct()
    made = found.select(F.expr(_let("ls", "cast(array() AS array<string>)", _surrogate(key))).alias("e"))
    plain = F.when(F.col("e.kind").isin("phone", "ssn", "card"), F.regexp_replace("e.other", "[^0-9+]", "")).when(F.col("e.kind") == "person", F.col("e.other")).otherwise(F.lower("e.other"))
    least = made.groupBy(F.col("e.kind").alias("kind"), plain.alias("other")).agg(F.min("e.same").alias("a"), F.max("e.same").alias("b"))
    return least.where("a <> b").select("kind", "other")


def clashes(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """``kind, other`` of every surrogate that stands for more than one entity in all documents; none for a sound key."""
    cut, place = marked(docs, text)
    return _clashing(cut, place, key)


def surrogated(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", into: str = "entities", attempts: int = 16) -> DataFrame:
    """``with_surrogates`` under the first key derived from ``key`` that has no clash in the corpus.

    Surrogates are permutations, so that a clash needs a given name that leads onto a listed one
    twice, or letters whose case does not come back; another key ends it. Null, empty and very
    long texts, ties, repeated rows and an empty table are as in ``with_surrogates``.
    """
    cut, place = marked(docs, text, into)
    for attempt in range(attempts):
        tried = key if attempt == 0 else f"{key}#{attempt}"
        if _clashing(cut, place, tried).isEmpty():
            return _replaced(cut, place, docs.columns, tried, text, into)
    raise ValueError(f"{attempts} keys had clashing surrogates")
