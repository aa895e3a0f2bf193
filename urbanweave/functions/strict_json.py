"""JSON texts held to the letter: no key twice in one object, no NaN or infinite number, nothing behind the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.columns import let

#: Strings, structure and everything else between spaces; possessive, so that long strings need no stack.
_STRING = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1F]*+)*+"'
_TOKEN = _STRING + r'|[{}\[\]:,]|[^ \t\n\r{}\[\]:,"]++'
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: What may come next; below 0 why a text was refused.
VALUE, FIRST, KEY, COLON, NEXT, ELEMENT, DONE, GRAMMAR, DUPLICATE, NUMBER = 0, 1, 2, 3, 4, 5, 6, -1, -2, -3
_STACK = "array<struct<object: boolean, keys: array<string>>>"


def _step(s: Column, token: Column) -> Column:
    """One token further: `expect` and a stack of the open containers with the keys that each object has so far."""
    expect, stack, sign = s["expect"], s["stack"], F.substring(token, 1, 1)
    top = F.element_at(stack, -1)
    go = lambda e, k=stack: F.struct((F.lit(e) if isinstance(e, int) else e).alias("expect"), k.cast(_STACK).alias("stack"))
    opened = lambda is_object: F.concat(stack, F.array(F.struct(F.lit(is_object).alias("object"), F.array().cast("array<string>").alias("keys"))))
    closed = let(F.slice(stack, F.lit(1), F.size(stack) - 1), lambda k: go(F.when(F.size(k) == 0, DONE).otherwise(NEXT), k))
    after = go(F.when(F.size(stack) == 0, DONE).otherwise(NEXT))
    name = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))  # escapes undone: keys are what they mean
    named = let(name, lambda n: F.when(F.array_contains(top["keys"], n), go(DUPLICATE)).otherwise(go(COLON, F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(F.struct(top["object"].alias("object"), F.array_append(top["keys"], n).alias("keys")))))))
    value, key = expect.isin(VALUE, ELEMENT), expect.isin(FIRST, KEY)
    finite = F.abs(token.try_cast("double")) < float("inf")
    return (
        F.when(expect < 0, s)
        .when(value & (sign == "{"), go(FIRST, opened(True)))
        .when(value & (sign == "["), go(ELEMENT, opened(False)))
        .when(value & ((sign == '"') | token.isin("true", "false", "null")), after)
        .when(value & token.rlike(_NUMBER), F.when(finite | ~token.rlike("[.eE]"), after).otherwise(go(NUMBER)))
        .when(value & token.isin("NaN", "Infinity", "-Infinity"), go(NUMBER))
        .when((expect == ELEMENT) & (sign == "]") | (expect == FIRST) & (sign == "}"), closed)
        .when(key & (sign == '"'), named)
        .when((expect == COLON) & (sign == ":"), go(VALUE))
        .when((expect == NEXT) & (sign == ","), go(F.when(top["object"], KEY).otherwise(VALUE)))
        .when((expect == NEXT) & (sign == F.when(top["object"], "}").otherwise("]")), closed)
        .otherwise(go(GRAMMAR))
    )


def refusal(text: Column) -> Column:
    """Why a JSON text is refused: GRAMMAR, DUPLICATE (a key twice in one object, at any depth, however it is escaped) or
    NUMBER (NaN, Infinity, or a number beyond the doubles); null if it is accepted. Null and blank texts are GRAMMAR.

    Tokens are folded left to right; the state holds the open containers and the keys seen in each.
    """
    start = F.struct(F.lit(VALUE).alias("expect"), F.array().cast(_STACK).alias("stack"))
    whole = F.regexp_replace(text, _TOKEN, "").rlike(r"^[ \t\n\r]*$")
    end = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, _step, lambda s: s["expect"])
    reason = let(end, lambda e: F.when(e == DUPLICATE, "DUPLICATE").when(e == NUMBER, "NUMBER").when(e != DONE, "GRAMMAR"))
    return F.when(text.isNull() | ~whole, "GRAMMAR").otherwise(reason)


def strict_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """All columns of `df`, `record` of the given schema for accepted texts, and `refused`, the reason of the others."""
    rows = df.withColumn("refused", refusal(F.col(column)))
    accepted = F.when(F.col("refused").isNull(), F.col(column))
    return rows.withColumn("record", F.from_json(accepted, schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}))
