"""English stems by the public Porter2 rules, as a chain of SQL expressions.

A step is one projection over the columns before it, so the optimizer keeps a
step's result in a column of its own. The same text runs in any engine with the
common string functions. Words are lower case; letters outside a-z count as
consonants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The tables of the rules, in their order there.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_WHOLE_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
_STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
).split()
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _cut(w: str, n: int, more: str = "") -> str:
    kept = f"left({w}, length({w}) - {n})"
    return f"concat({kept}, '{more}')" if more else kept


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _suffixes(table: dict[str, str], region: str, conditions: dict[str, str]) -> str:
    """The longest suffix of the table, replaced if it lies in the region and its condition holds."""
    cases = []
    for suffix in sorted(table, key=lambda s: (-len(s), s)):
        n = len(suffix)
        test = conditions.get(suffix, f"length(w) - {n} >= {region}").format(n=n)
        cases.append(f"WHEN right(w, {n}) = '{suffix}' THEN CASE WHEN {test} THEN {_cut('w', n, table[suffix])} ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _before(n: int, letters: str) -> str:
    return _has(f"substr(w, length(w) - {n}, 1)", f"[{letters}]")


def _steps() -> list[dict[str, str]]:
    """Each step's new columns; `w` is the word so far, `p1` and `p2` where its regions begin."""
    marked = "CASE WHEN left({t}, 1) = 'y' THEN concat('Y', substr({t}, 2)) ELSE {t} END"
    for vowel in "aeiouy":
        marked = f"replace({marked}, '{vowel}y', '{vowel}Y')"
    region = f"length(regexp_extract({{x}}, '{_REGION}', 0))"
    first = region.format(x="w")
    start = (
        f"CASE WHEN left(w, 5) IN ('gener', 'arsen') THEN 5 WHEN left(w, 6) = 'commun' THEN 6 "
        f"WHEN {first} = 0 THEN length(w) ELSE {first} END"
    )
    second = region.format(x="substr(w, p1 + 1)")
    vowel = "[aeiouy]"
    plural = (
        f"CASE WHEN right(w, 4) = 'sses' THEN {_cut('w', 2)} "
        f"WHEN right(w, 3) IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut('w', 2)} ELSE {_cut('w', 1)} END "
        f"WHEN right(w, 2) IN ('us', 'ss') THEN w "
        f"WHEN right(w, 1) = 's' AND {_has(_cut('w', 2), vowel)} THEN {_cut('w', 1)} ELSE w END"
    )
    ending = (
        "CASE WHEN right(w, 5) = 'eedly' OR right(w, 3) = 'eed' THEN 0 WHEN right(w, 5) = 'ingly' THEN 5 "
        "WHEN right(w, 4) = 'edly' THEN 4 WHEN right(w, 3) = 'ing' THEN 3 WHEN right(w, 2) = 'ed' THEN 2 ELSE 0 END"
    )
    stripped = f"CASE WHEN k > 0 AND {_has('left(w, length(w) - k)', vowel)} THEN left(w, length(w) - k) END"
    past = (
        f"CASE WHEN c IS NOT NULL THEN CASE WHEN right(c, 2) IN ('at', 'bl', 'iz') THEN concat(c, 'e') "
        f"WHEN right(c, 2) IN ({_listed(_DOUBLES)}) THEN {_cut('c', 1)} "
        f"WHEN length(c) <= p1 AND {_has('c', _SHORT)} THEN concat(c, 'e') ELSE c END "
        f"WHEN right(w, 5) = 'eedly' AND length(w) - 5 >= p1 THEN {_cut('w', 3)} "
        f"WHEN right(w, 3) = 'eed' AND length(w) - 3 >= p1 THEN {_cut('w', 1)} ELSE w END"
    )
    last_y = f"CASE WHEN right(w, 1) IN ('y', 'Y') AND length(w) > 2 AND {_before(1, '^aeiouy')} THEN {_cut('w', 1, 'i')} ELSE w END"
    in_1, in_2 = "length(w) - {n} >= p1", "length(w) - {n} >= p2"
    last_e = (
        f"CASE WHEN right(w, 1) = 'e' AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT ({_has(_cut('w', 1), _SHORT)}))) "
        f"THEN {_cut('w', 1)} WHEN right(w, 2) = 'll' AND length(w) - 1 >= p2 THEN {_cut('w', 1)} ELSE w END"
    )
    return [
        {"w": marked},
        {"p1": start},
        {"p2": f"CASE WHEN {second} = 0 THEN length(w) ELSE p1 + {second} END"},
        {"w": plural},
        {"a": "w", "k": ending},
        {"c": stripped},
        {"w": past},
        {"w": last_y},
        {"w": _suffixes(_STEP_2, "p1", {"ogi": f"{in_1} AND {_before(3, 'l')}", "li": f"{in_1} AND {_before(2, 'cdeghkmnrt')}"})},
        {"w": _suffixes(_STEP_3, "p1", {"ative": in_2})},
        {"w": _suffixes(dict.fromkeys(_STEP_4, ""), "p2", {"ion": f"{in_2} AND {_before(3, 'st')}"})},
        {"w": last_e},
    ]


def _result(token: str) -> str:
    listed = " ".join(f"WHEN {token} = '{word}' THEN '{stem}'" for word, stem in _EXCEPTIONS.items())
    return (
        f"CASE {listed} WHEN length({token}) <= 2 THEN {token} "
        f"WHEN a IN ({_listed(_WHOLE_AFTER_PLURAL)}) THEN replace(a, 'Y', 'y') ELSE replace(w, 'Y', 'y') END"
    )


def with_stems(tokens: DataFrame, token: str = "token", stem: str = "stem") -> DataFrame:
    """`tokens` with the stem of each lower-case token; a null token has none."""
    names = [f"`{c}`" for c in tokens.columns]
    held: list[str] = []
    df = tokens
    for step in _steps():
        kept = [c for c in held if c not in step]
        df = df.selectExpr(*names, *kept, *[f"{e.replace('{t}', f'`{token}`')} AS {c}" for c, e in step.items()])
        held = [*kept, *step]
    return df.selectExpr(*names, f"{_result(f'`{token}`')} AS `{stem}`")


def stems_sql(relation: str, token: str = "token", stem: str = "stem") -> str:
    """The same as one SELECT over a relation, as SQL text."""
    sql, held = relation, []
    for step in _steps():
        kept = [c for c in held if c not in step]
        made = [f"{e.replace('{t}', f'_t.{token}')} AS {c}" for c, e in step.items()]
        own = f"_t.* EXCLUDE ({', '.join(c for c in held if c in step)})" if any(c in step for c in held) else "_t.*"
        sql, held = f"(SELECT {', '.join([own, *made])} FROM {sql} AS _t)", [*kept, *step]
    return f"SELECT _t.* EXCLUDE ({', '.join(held)}), {_result(f'_t.{token}')} AS {stem} FROM {sql} AS _t"
