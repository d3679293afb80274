"""Secrets taken out of texts. The order of the steps is part of what they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EDGE, SPACE, entropy, length, let, trim

#: Fixed values: (type of a finding, pattern with {b} for a word edge and {s} for white space, group
#: that holds the secret, replacement).
_KEY = "(?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----"
STEPS = (
    ("private-key", rf"-----BEGIN {_KEY}(?s:.*?)-----END {_KEY}", 0, "[REDACTED:private-key]"),
    ("connection-password", r"(?i){b}([a-z][a-z0-9+.\-]*://)([^{s}:/@]+):([^{s}:/@]+)@", 3, "$1$2:[REDACTED:password]@"),
    ("bearer-token", r"{b}([Bb]earer)[{s}]+([A-Za-z0-9._\-+/=]{{8,}})", 2, "$1 [REDACTED:bearer-token]"),
    ("secret-assignment", r"(?i){b}([A-Za-z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|PRIVATE[_-]?KEY|API[_-]?KEY|ACCESS[_-]?KEY|CLIENT[_-]?SECRET|AUTH[_-]?KEY)[A-Za-z0-9_]*)[{s}]*[:=][{s}]*\"?([^{s}\"'\]\[]{{4,}})\"?", 2, "$1=[REDACTED:secret]"),
    ("jwt", r"{b}eyJ[A-Za-z0-9_-]{{6,}}\.[A-Za-z0-9_-]{{6,}}\.[A-Za-z0-9_-]{{6,}}{b}", 0, "[REDACTED:jwt]"),
    ("aws-key", r"{b}(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[0-9A-Z]{{16}}{b}", 0, "[REDACTED:aws-key]"),
    ("github-token", r"{b}gh[pousr]_[A-Za-z0-9]{{20,}}{b}", 0, "[REDACTED:github-token]"),
    ("slack-token", r"{b}xox[baprs]-[A-Za-z0-9-]{{10,}}{b}", 0, "[REDACTED:slack-token]"),
    ("google-api-key", r"{b}AIza[0-9A-Za-z_-]{{20,}}{b}", 0, "[REDACTED:google-api-key]"),
    ("apikey", r"{b}sk-(?:ant-|proj-|live-|test-)?[A-Za-z0-9_-]{{16,}}{b}", 0, "[REDACTED:apikey]"),
)
LONG = r"{b}[A-Za-z0-9+/_=-]{{40,}}{b}"
SOME_TOKEN = "[A-Za-z0-9+/_=-]{40}"
#: What a text must hold for a step to find anything.
GATES = {
    "private-key": lambda s: s.contains("PRIVATE KEY"), "connection-password": lambda s: s.contains("://"), "bearer-token": lambda s: s.contains("earer"),
    "secret-assignment": lambda s: s.rlike("[:=]") & s.rlike("(?i)(?:secret|token|passw|key)"), "jwt": lambda s: s.contains("eyJ"), "aws-key": lambda s: s.rlike("A[KSGIRN][IDOPV]A"),
    "github-token": lambda s: s.rlike("gh[pousr]_"), "slack-token": lambda s: s.contains("xox"), "google-api-key": lambda s: s.contains("AIza"), "apikey": lambda s: s.contains("sk-"),
}


def pattern(p: str, edge: str = EDGE, space: str = SPACE) -> str:
    return p.replace("{b}", edge).replace("{s}", space).replace("{{", "{").replace("}}", "}")


def _is_token(s: Column) -> Column:
    return s.rlike("[A-Za-z]") & s.rlike("[0-9]") & (entropy(s) >= 4.0)


def tokens(s: Column) -> Column:
    """Runs of 40 token characters and more."""
    return F.regexp_extract_all(s, F.lit(pattern(LONG)), 0)


def redact_structured(s: Column) -> Column:
    """All steps but the last, for tokens of high entropy."""
    for step in STEPS:
        s = let(s, _replaced(step))
    return s


def _replaced(step: tuple):
    name, p, _, new = step
    return lambda t: F.when(GATES[name](t), F.regexp_replace(t, pattern(p), new)).otherwise(t)


def redact_tokens(s: Column) -> Column:
    """Tokens of 40 characters and more with letters, digits and at least 4 bits of entropy a character."""
    # the text between tokens: one piece more than there are tokens
    new = lambda t: F.transform(tokens(t), lambda p: F.when(_is_token(p), "[REDACTED:token]").otherwise(p))
    joined = lambda t: F.array_join(F.zip_with(F.split(t, pattern(LONG), -1), new(t), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return let(s, lambda t: F.when(t.rlike(SOME_TOKEN), joined(t)).otherwise(t))


def redact(s: Column) -> Column:
    return redact_tokens(redact_structured(s))


def masked(s: Column) -> Column:
    """A preview that doesn't give the secret away."""
    def preview(s: Column) -> Column:
        n = length(s)
        return F.when(n <= 6, F.repeat(F.lit("*"), n.cast("int"))).otherwise(F.concat(F.substring(s, 1, 3), F.lit("…"), F.substring(s, -2, 2), F.lit(" ("), n.cast("string"), F.lit(" chars)")))

    return let(trim(F.regexp_replace(s, rf"[{SPACE}]+", " ")), preview)


_FINDINGS = "array<struct<type:string,preview:string>>"


def with_redaction(rows: DataFrame, text: str = "text", shown=masked) -> DataFrame:
    """rows with text redacted and found, an array of (type, preview) in the order of the steps; shown: what a preview gives of a secret."""
    state = F.struct(F.col(text).alias("t"), F.array().cast(_FINDINGS).alias("found"))
    for step in STEPS:
        state = let(state, _searched(step, shown))
    high = lambda x: _found("high-entropy", F.filter(tokens(x["t"]), _is_token), shown).cast(_FINDINGS)
    last = lambda x: F.struct(redact_tokens(x["t"]).alias("t"), F.when(x["t"].rlike(SOME_TOKEN), F.concat(x["found"], high(x))).otherwise(x["found"]).alias("found"))
    done = rows.select(*(c for c in rows.columns if c != "found"), let(state, last).alias("found"))
    return done.withColumn(text, F.col("found.t")).withColumn("found", F.col("found.found"))


def secrets(rows: DataFrame, text: str = "text") -> DataFrame:
    """(type, secret) of every finding in the texts, unmasked: for checks that nothing of it is kept, not for keeping."""
    return unmasked(with_redaction(rows.select(F.col(text).alias("text")), shown=lambda s: s))


def unmasked(rows: DataFrame) -> DataFrame:
    """(type, secret) of the findings of with_redaction(), whose previews show all."""
    return rows.select(F.explode("found").alias("f")).select("f.type", F.col("f.preview").alias("secret"))


def _searched(step: tuple, shown):
    """One step on (t, found): the text before it, and what was found so far."""
    name, p, group, new = step
    def of(x: Column) -> Column:
        some, hits = GATES[name](x["t"]), F.regexp_extract_all(x["t"], F.lit(pattern(p)), group)
        found = F.when(some, F.concat(x["found"], _found(name, hits, shown).cast(_FINDINGS))).otherwise(x["found"])
        return F.struct(F.when(some, F.regexp_replace(x["t"], pattern(p), new)).otherwise(x["t"]).alias("t"), found.alias("found"))

    return of


def _found(name: str, hits: Column, shown) -> Column:
    return F.transform(hits, lambda m: F.struct(F.lit(name).alias("type"), shown(m).alias("preview")))


def leaks(s: Column) -> Column:
    """Whether a text holds what redaction would replace."""
    return redact(s) != s
