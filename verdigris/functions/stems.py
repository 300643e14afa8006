"""English stems of words, by the published Snowball rules ("Porter2"), as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.similarity import let

#: Words that full-text search leaves out.
STOP_WORDS = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don should now""".split())  # fmt: skip

#: The rules' letters, exceptions and endings.
_V, _C = "[aeiouy]", "[^aeiouy]"
_DOUBLE = r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
_SHORT = rf"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$"
_PREFIXES = "gener|commun|arsen"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "logi": "log", "fulli": "ful", "lessli": "less",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _cut(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _ending(word: Column, rules: dict[str, Callable[[], Column]]) -> Column:
    """What the rule of the longest ending makes of a word; others stay."""
    out = word
    for ending in sorted(rules, key=len):
        out = F.when(word.endswith(ending), rules[ending]()).otherwise(out)
    return out


def _replaced(word: Column, ending: str, new: str, start: Column) -> Column:
    """The ending replaced where it lies in the region from ``start``."""
    return F.when(F.length(word) - len(ending) >= start, F.concat(_cut(word, len(ending)), F.lit(new))).otherwise(word)


def _plural(w: Column, r1: Column, r2: Column) -> Column:
    ie = lambda: F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    same = lambda: w
    return _ending(w, {"sses": lambda: _cut(w, 2), "ied": ie, "ies": ie, "us": same, "ss": same, "s": lambda: F.when(w.rlike(rf"{_V}.+s$"), _cut(w, 1)).otherwise(w)})


def _past(w: Column, r1: Column, r2: Column) -> Column:
    def mended(x: Column) -> Column:
        short = x.rlike(_SHORT) & (r1 >= F.length(x))
        return F.when(x.rlike("(?:at|bl|iz)$") | (short & ~x.rlike(_DOUBLE)), F.concat(x, F.lit("e"))).when(x.rlike(_DOUBLE), _cut(x, 1)).otherwise(x)

    def gone(ending: str) -> Callable[[], Column]:
        return lambda: F.when(_cut(w, len(ending)).rlike(_V), let(_cut(w, len(ending)), mended)).otherwise(w)

    rules = {e: gone(e) for e in ("ed", "edly", "ing", "ingly")}
    return _ending(w, rules | {e: lambda e=e: _replaced(w, e, "ee", r1) for e in ("eed", "eedly")})


def _last_y(w: Column, r1: Column, r2: Column) -> Column:
    return F.when(w.rlike(rf".{_C}[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _second(w: Column, r1: Column, r2: Column) -> Column:
    # The l of "logi" only has to stand there: its ending is "ogi".
    rules = {e: lambda e=e, new=new: _replaced(w, e, new, r1 - int(e == "logi")) for e, new in _SECOND.items()}
    return _ending(w, rules | {"li": lambda: F.when(w.rlike("[cdeghkmnrt]li$"), _replaced(w, "li", "", r1)).otherwise(w)})


def _third(w: Column, r1: Column, r2: Column) -> Column:
    rules = {e: lambda e=e, new=new: _replaced(w, e, new, r1) for e, new in _THIRD.items()}
    return _ending(w, rules | {"ative": lambda: _replaced(w, "ative", "", F.greatest(r1, r2))})


def _fourth(w: Column, r1: Column, r2: Column) -> Column:
    rules = {e: lambda e=e: _replaced(w, e, "", r2) for e in _FOURTH}
    return _ending(w, rules | {"ion": lambda: F.when(w.rlike("[st]ion$"), _replaced(w, "ion", "", r2)).otherwise(w)})


def _last(w: Column, r1: Column, r2: Column) -> Column:
    n = F.length(w) - 1
    e = (n >= r2) | ((n >= r1) & ~_cut(w, 1).rlike(_SHORT))
    return F.when((w.endswith("e") & e) | (w.endswith("ll") & (n >= r2)), _cut(w, 1)).otherwise(w)


def english(word: Column) -> Column:
    """The stem of a lower-cased word; words of one or two letters and null stay."""
    exceptions = F.create_map(*[F.lit(x) for pair in _WHOLE.items() for x in pair])
    spelt = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({_V})y", "$1Y")

    def region(text: Column, pattern: str) -> Column:
        found = F.length(F.regexp_extract(text, pattern, 0))
        return F.when(found == 0, F.length(text)).otherwise(found)

    def steps(w: Column, r1: Column, r2: Column, todo: list) -> Column:
        return let(todo[0](w, r1, r2), lambda x: steps(x, r1, r2, todo[1:])) if todo else w

    def stemmed(w: Column) -> Column:
        first = let(region(w, rf"^(?:(?:{_PREFIXES})|.*?{_V}{_C})"), lambda r1: F.struct(r1.alias("a"), (r1 + region(F.substr(w, r1 + 1), rf"^.*?{_V}{_C}")).alias("b")))
        rest = lambda x, r: F.when(x.isin(*_DONE), x).otherwise(steps(x, r["a"], r["b"], [_past, _last_y, _second, _third, _fourth, _last]))
        return let(first, lambda r: let(_plural(w, r["a"], r["b"]), lambda x: rest(x, r)))

    return F.coalesce(F.try_element_at(exceptions, word), F.when(F.length(word) <= 2, word).otherwise(F.lower(let(spelt, stemmed))))
