"""Porter's stemmer as a chain of CASE expressions, written once and rendered for two SQL dialects.

Every step is a projection of its own, so expressions don't nest and Catalyst keeps them apart. It is
meant for a vocabulary: stem the distinct terms and join them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import fresh, quoted

# Porter (1980). Letter classes (Y stands for a consonant y) and tests on a stem.
_V, _C = "[aeiouy]", "[^aeiou]"
_CS, _VS = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
M_OVER_0 = f"^({_CS})?{_VS}{_C}"
M_OVER_1 = f"^({_CS})?{_VS}{_CS}{_VS}{_C}"
M_IS_1 = f"^({_CS})?{_VS}{_CS}({_VS})?$"
HAS_VOWEL = f"^({_CS})?{_V}"
SHORT = f"^{_CS}{_V}[^aeiouwxyY]$"
# Suffixes and what stands for them.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "eli": "e", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alli": "al", "alism": "al", "aliti": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
DOUBLES = "bb|dd|ff|gg|mm|nn|pp|rr|tt"


def _steps(like: str, w: str) -> list[str]:
    """Expressions over the column w, each over the one before; `like` is the dialect's regular expression test."""

    def has(text: str, pattern: str) -> str:
        return f"{like}({text}, '{pattern}')"

    def head(n: int, text: str = w) -> str:
        return f"substr({text}, 1, length({text}) - {n})"

    def swap(suffixes: dict[str, str], test: str) -> str:
        """The longest suffix decides, whether or not its stem passes."""
        out = "CASE"
        for s in sorted(suffixes, key=lambda x: (-len(x), x)):
            fit = f" AND {has(head(len(s)), test)}" if test else ""
            new = f"{head(len(s))} || '{suffixes[s]}'"
            out += f" WHEN {has(w, s + '$')} THEN " + (f"CASE WHEN {fit[5:]} THEN {new} ELSE {w} END" if test else new)
        return out + f" ELSE {w} END"

    step_4 = "CASE"
    for s in sorted([*STEP_4, "ion"], key=lambda x: (-len(x), x)):
        test = has(head(len(s)), M_OVER_1) + (f" AND {has(head(3), '[st]$')}" if s == "ion" else "")
        step_4 += f" WHEN {has(w, s + '$')} THEN CASE WHEN {test} THEN {head(len(s))} ELSE {w} END"
    return [
        f"CASE WHEN {has(w, '^y')} THEN 'Y' || substr({w}, 2) ELSE {w} END",
        swap(STEP_1A, ""),
        f"CASE WHEN {has(w, 'eed$')} THEN CASE WHEN {has(head(3), M_OVER_0)} THEN {head(1)} ELSE {w} END"
        f" WHEN {has(w, 'ed$')} THEN CASE WHEN {has(head(2), HAS_VOWEL)} THEN {head(2)} || '|' ELSE {w} END"
        f" WHEN {has(w, 'ing$')} THEN CASE WHEN {has(head(3), HAS_VOWEL)} THEN {head(3)} || '|' ELSE {w} END ELSE {w} END",
        # a trailing bar says that step 1b has cut an ending off
        f"CASE WHEN NOT {has(w, '[|]$')} THEN {w} WHEN {has(w, '(at|bl|iz)[|]$')} THEN {head(1)} || 'e' WHEN {has(w, f'({DOUBLES})[|]$')} THEN {head(2)}"
        f" WHEN {has(head(1), M_IS_1)} AND {has(head(1), SHORT)} THEN {head(1)} || 'e' ELSE {head(1)} END",
        f"CASE WHEN {has(w, 'y$')} AND {has(head(1), HAS_VOWEL)} THEN {head(1)} || 'i' ELSE {w} END",
        swap(STEP_2, M_OVER_0),
        swap(STEP_3, M_OVER_0),
        step_4 + f" ELSE {w} END",
        f"CASE WHEN {has(w, 'e$')} AND ({has(head(1), M_OVER_1)} OR ({has(head(1), M_IS_1)} AND NOT {has(head(1), SHORT)})) THEN {head(1)} ELSE {w} END",
        f"CASE WHEN {has(w, 'll$')} AND {has(w, M_OVER_1)} THEN {head(1)} ELSE {w} END",
        f"replace({w}, 'Y', 'y')",
    ]


def stem(terms: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the stem of a lower-case column; null stays null, an empty table stays empty, repeated rows come out as often.

    A column named like out is replaced; all others stay, whatever their names.
    A filter on the stem, or the null test that a join on it brings along, is pushed through all steps and grows
    with each. Where stems are joined or filtered, use vocabulary().
    """
    kept = [quoted(c) for c in terms.columns if c.lower() != out.lower()]
    w = quoted(fresh("stem_step", terms.columns))
    df = terms.selectExpr(*kept, f"{quoted(column)} AS {w}")
    for step in _steps("regexp_like", w):
        df = df.selectExpr(*kept, f"{step} AS {w}")
    return df.selectExpr(*kept, f"{w} AS {quoted(out)}")


def vocabulary(terms: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): the distinct terms and their stems; the stem comes out of an aggregate, which no filter on it can pass."""
    if column.lower() == out.lower():
        raise ValueError("the stem needs a column of its own")
    return stem(terms.select(column).distinct(), column, out).groupBy(column).agg(F.first(out).alias(out))


def stem_sql(source: str, column: str, out: str, like: str = "regexp_matches", helper: str = "stem_step") -> str:
    """The same over a table or subquery, as SQL of another dialect; the source must have no column named helper or out."""
    sql = f"SELECT *, {column} AS {helper} FROM {source}"
    for step in _steps(like, helper):
        sql = f"SELECT * REPLACE ({step} AS {helper}) FROM ({sql})"
    return f"SELECT * EXCLUDE ({helper}), {helper} AS {out} FROM ({sql})"
