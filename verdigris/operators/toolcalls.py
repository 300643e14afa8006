"""Comparing expected and actual tool calls, which are nested and unordered, by expressions alone.

A JSON text is parsed once, its keys and values marked by kind: ``"s..."`` a text, ``"#..."`` a number with its digits as they
were. Written again with sorted keys and cut into tokens, two values have equal structure where they have the same tokens but
for texts and numbers, so that nested values are compared token by token, however deep they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import fiscal
from verdigris.functions.similarity import let

#: Older names of tools.
CANONICAL = {"datastream.get_data": "get_data", "refinitiv.get_data": "get_data", "datastream_get_data": "get_data", "refinitiv_get_data": "get_data"}
TOLERANCE = 1e-4

_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A text, with the colon behind it if it is a key; a word; else one character, as JSON is written again.
_TOKEN = rf"(?s){_TEXT}:?|true|false|null|."
#: What goes before a number outside texts, and the number.
_BEFORE_NUMBER = rf"(?s)\G((?:[^\"0-9-]|{_TEXT})*+)(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)"
#: Texts that are read as numbers.
_DIGITS = r"\d+(?:_\d+)*"
_LIKE_NUMBER = r'^"s(?:\s|\\[tnrf])*+[+-]?\.?\d'
_NUMBER = rf"^\s*[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"
#: Values that don't count as a name.
_NO_NAME = r'^(?:null|false|\[\]|\{\}|"s"|"#-?0(?:\.0+)?(?:[eE].*)?")$'


def _tokens(text: Column) -> Column:
    """The tokens of a JSON text, each with its value as a number, read here once and not for each comparison."""
    cut = lambda t: F.when(t.startswith("{") | t.startswith("["), F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))).when(t.isNotNull(), F.array(t))
    return F.transform(let(text, cut), lambda t: F.struct(t.alias("text"), _value(t).alias("number")))


def _parsed(text: Column) -> Column:
    """The variant of a list of the JSON text's value and a mark that no text holds; null for null, broken JSON and keys that
    repeat. Text after the value's end keeps the mark from its place."""
    texts = F.regexp_replace(text, rf"(?s)\"({_TEXT[1:-1]})\"", '"s$1"')
    return F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(texts, _BEFORE_NUMBER, '$1"#$2"'), F.lit(',"e"]')))


def _read(parsed: Column) -> Column:
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == "e", F.lit(False))


def _map(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "map<string,variant>")


def _list(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _value(token: Column) -> Column:
    """A value's token as a number; null for other tokens and texts that are none. Only texts that begin like one are read by
    patterns, as this is done for each token."""
    body = F.substr(token, F.lit(3), F.length(token) - 3)
    plain = F.when(F.contains(token, F.lit("\\")), F.regexp_replace(body, r"\\[tnrf]", " ")).otherwise(body)
    read = let(plain, lambda t: F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")))
    text = F.when(~token.endswith(":") & token.rlike(_LIKE_NUMBER), read)
    return F.when(token.startswith('"#'), body.try_cast("double")).when(token.startswith('"'), text).when(token == "true", 1.0).when(token == "false", 0.0)


def _near(want: Column, got: Column) -> Column:
    a, b = want["number"], got["number"]
    kind, real = F.substring(want["text"], 1, 2), "[.eE]"
    close = F.when(a == 0, F.abs(b) <= TOLERANCE).otherwise((F.abs(a) < float("inf")) & (F.abs(a - b) <= TOLERANCE * F.abs(a)))
    comparable = (kind != F.substring(got["text"], 1, 2)) | ((kind == '"#') & (want["text"].rlike(real) | got["text"].rlike(real) | ((a == 0) & (b == 0))))
    return (want["text"] == got["text"]) | (F.coalesce(close, F.lit(False)) & comparable)


def _alike(want: Column, got: Column) -> Column:
    """Whether two values, as tokens, are equal: numbers in text form taken as numbers, a relative tolerance where one isn't a
    whole number, ordered lists and unordered objects; null equals null alone. The first token that differs ends it."""
    pairs = F.zip_with(want, got, lambda w, g: F.struct(w.alias("w"), g.alias("g")))
    return (F.size(want) == F.size(got)) & F.forall(pairs, lambda p: _near(p["w"], p["g"]))


def _identity(tokens: Column) -> Column:
    """The text by which equal calls are told: 1, 1.0 and true are equal, and "1" is another."""

    def plain(t: Column) -> Column:
        number = F.substr(t, F.lit(3), F.length(t) - 3).try_cast("double")
        is_whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        real = F.concat(F.lit('"#'), F.when(is_whole, number.cast("long").cast("string")).otherwise(number.cast("string")), F.lit('"'))
        return F.when(t == "true", '"#1"').when(t == "false", '"#0"').when(t.rlike('^"#(?:-0"|.*[.eE])'), real).otherwise(t)

    return F.array_join(F.transform(tokens, lambda t: plain(t["text"])), "")


def _calls(parsed: Column) -> Column:
    """array<struct<name, tokens>> of a parsed text: a list, one call, or an object with ``tool_calls``; names may be
    ``tool_name`` or ``name``. Null where the text has another form."""
    names = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])

    def fields(m: Column) -> Column:
        json = lambda key: F.to_json(F.try_element_at(m, F.lit(key)))
        name = let(json("stool_name"), lambda first: F.when(first.isNull() | first.rlike(_NO_NAME), json("sname")).otherwise(first))
        return F.struct(name.alias("name"), F.when(F.map_contains_key(m, "sarguments"), json("sarguments")).otherwise("{}").alias("arguments"))

    def items(m: Column) -> Column:
        calls = F.when(F.map_contains_key(m, "stool_calls"), _list(F.try_element_at(m, F.lit("stool_calls")))).when(m.isNull(), _list(parsed, "$[0]"))
        several = F.transform(calls, lambda c: let(_map(c), fields))
        return F.when(m.isNotNull() & ~F.map_contains_key(m, "stool_calls"), F.array(fields(m))).otherwise(several)

    def made(call: Column) -> Column:
        name = F.substr(call["name"], F.lit(3), F.length(call["name"]) - 3)
        return F.struct(F.coalesce(F.try_element_at(names, name), name).alias("name"), _tokens(call["arguments"]).alias("tokens"))

    right = lambda c: F.coalesce(c["name"].startswith('"s') & c["arguments"].startswith("{"), F.lit(False))
    return let(let(_map(parsed, "$[0]"), items), lambda calls: F.when(F.forall(calls, right), F.transform(calls, made)))


def _matched(want: Column, got: Column) -> Column:
    """struct(free, matched, n, differing) after the expected calls have chosen in order: a perfect match if there is one, else
    the first free call of the same name."""
    start = F.struct(
        F.filter(F.sequence(F.lit(0), F.size(got)), lambda i: i < F.size(got)).alias("free"), F.array().cast("array<struct<name:string,tokens:array<struct<text:string,number:double>>>>").alias("matched"), F.lit(0).alias("n"), F.lit(0).alias("differing")
    )

    def choose(state: Column, call: Column) -> Column:
        call_of = lambda i: F.get(got, i)
        perfect = lambda same: F.get(F.filter(same, lambda i: _alike(call["tokens"], call_of(i)["tokens"])), F.lit(0))
        same = F.filter(state["free"], lambda i: call_of(i)["name"] == call["name"])
        best = let(same, lambda s: F.struct(F.get(s, F.lit(0)).alias("first"), perfect(s).alias("perfect")))

        def take(b: Column) -> Column:
            free = F.filter(state["free"], lambda i: i != F.coalesce(b["perfect"], b["first"]))
            taken = F.struct(free.alias("free"), F.array_append(state["matched"], call).alias("matched"), (state["n"] + 1).alias("n"), (state["differing"] + b["perfect"].isNull().cast("int")).alias("differing"))
            return F.when(b["first"].isNull(), state).otherwise(taken)

        return let(best, take)

    return F.aggregate(want, start, choose)


def _hidden(df: DataFrame, *names: str) -> list[str]:
    """Names that no column has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def diff_arguments(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Add missing_keys (that the actual object lacks), extra_keys (that only it has) and value_diffs (keys whose values
    differ), sorted arrays of text, of two JSON objects of arguments; null where either is no object. Columns of these names
    are replaced."""
    w, g = _hidden(df, "__want", "__got")
    values = lambda m: F.transform_values(F.transform_keys(m, lambda k, _: F.substr(k, F.lit(2))), lambda _, v: _tokens(F.to_json(v)))
    given = lambda c: let(_parsed(F.col(c)), lambda v: F.when(_read(v), values(_map(v, "$[0]"))))
    keys = lambda c: F.map_keys(F.col(c))
    differ = lambda k: ~_alike(F.try_element_at(F.col(w), k), F.try_element_at(F.col(g), k))
    out = df.withColumns({w: given(expected), g: given(actual)})
    parts = {"missing_keys": F.array_except(keys(w), keys(g)), "extra_keys": F.array_except(keys(g), keys(w)), "value_diffs": F.filter(F.array_intersect(keys(w), keys(g)), differ)}
    return out.withColumns({name: F.array_sort(part) for name, part in parts.items()}).drop(w, g)


#: Arguments that hold dates.
DATE_FIELDS = ("start", "end", "SDate", "EDate", "Period")
_CALLS = "array<struct<tool_name:string,name:string,arguments:map<string,variant>>>"


def judge_temporal(df: DataFrame, expected: str, actual: str, on: Column, mode: str = "structural") -> DataFrame:
    """As ``judge``, for calls whose date arguments may be spelt in several ways. Both columns hold JSON lists of calls.

    structural: dates are resolved as of ``on`` before the comparison. behavioural: every date must be a valid expression
    (else score 0 and the error INVALID_DATE), and dates aren't compared. data: nothing is changed. Lists that can't be
    read, and null, are judged as they are."""
    if mode == "data":
        return judge(df, expected, actual)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    dated = lambda k, v: k.isin(*DATE_FIELDS) & text(v).isNotNull()

    def changed(call: Column) -> Column:
        given = call["arguments"]
        if mode == "structural":
            given = F.transform_values(given, lambda k, v: F.when(dated(k, v), fiscal.normalized(text(v), on).cast("variant")).otherwise(v))
        else:
            given = F.map_filter(given, lambda k, _: ~k.isin(*DATE_FIELDS))
        return F.struct(F.coalesce(call["tool_name"], call["name"]).alias("tool_name"), given.alias("arguments"))

    calls = {c: F.from_json(c, _CALLS) for c in (expected, actual)}
    new = {f"__{c}": F.coalesce(F.to_json(F.transform(v, changed)), F.col(c)) for c, v in calls.items()}
    wrong = lambda v: F.exists(v, lambda c: F.size(F.map_filter(c["arguments"], lambda k, a: dated(k, a) & ~fiscal.is_expression(text(a)))) > 0)
    bad = F.lit(False) if mode == "structural" else F.coalesce(wrong(calls[expected]), F.lit(False)) | F.coalesce(wrong(calls[actual]), F.lit(False))
    judged = judge(df.withColumns(new | {"__bad": bad}), f"__{expected}", f"__{actual}")
    judged = judged.withColumns({"error": F.when(F.col("__bad"), "INVALID_DATE").otherwise(F.col("error")), "score": F.when(F.col("__bad"), 0.0).otherwise(F.col("score"))})
    return judged.withColumn("verdict", F.when(F.col("__bad"), "INVALID_DATE").otherwise(F.col("verdict"))).drop(*new, "__bad")


def judge(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Add error, score, missing, extra, differing and verdict, in which missing calls go before extra ones and those before
    differing arguments. Both columns hold JSON: a list of calls, one call, or an object with ``tool_calls``.

    Null, empty and broken JSON (NaN among it), and objects that repeat a key, give INVALID_JSON, other forms SCHEMA_VIOLATION, both score 0;
    the expected calls' error goes first. An expected call that equals a matched one isn't missing. Texts beyond the size of a
    variant (128 MiB) count as broken. Columns of these names are replaced."""
    w, g, wc, gc, m = _hidden(df, "__want", "__got", "__want_calls", "__got_calls", "__matched")
    out = df.withColumns({w: _parsed(F.col(expected)), g: _parsed(F.col(actual))})
    out = out.withColumns({wc: _calls(F.col(w)), gc: _calls(F.col(g))})
    error = lambda v, calls: F.when(~_read(F.col(v)), "INVALID_JSON").when(F.col(calls).isNull(), "SCHEMA_VIOLATION")
    out = out.withColumns({"error": F.coalesce(error(w, wc), error(g, gc)), m: _matched(F.col(wc), F.col(gc))})
    n_want, n_got, state, ok = F.size(wc), F.size(gc), F.col(m), F.col("error").isNull()
    score = F.when(n_want == 0, (n_got == 0).cast("double")).otherwise((state["n"] - state["differing"]) / F.greatest(n_want, n_got))
    same = lambda c: F.concat_ws("\n", c["name"], _identity(c["tokens"]))
    lost = let(F.transform(state["matched"], same), lambda found: F.size(F.filter(F.col(wc), lambda c: ~F.array_contains(found, same(c)))))
    missing = F.when(state["n"] == n_want, 0).otherwise(lost)
    values = {"score": F.when(ok, score).otherwise(0.0), "missing": missing, "extra": F.size(state["free"]), "differing": state["differing"]}
    out = out.withColumns({name: v if name == "score" else F.when(ok, v).otherwise(0) for name, v in values.items()})
    return out.withColumn("verdict", verdict()).drop(w, g, wc, gc, m)


def verdict() -> Column:
    return (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("missing") > 0, "MISSING_CALL").when(F.col("extra") > 0, "EXTRA_CALL").when(F.col("differing") > 0, "WRONG_ARGUMENTS").otherwise("OK")
    )
