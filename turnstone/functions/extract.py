"""Candidate statements of a text: noise, kinds, sentences, code blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CANDIDATE
from .text import EDGE, EMOJI, SPACE, alnum_length, at_least_alnum, at_least_words, collapse, length, let, shorter, trim

#: Markers and fillers (fixed values), to be matched without regard to case; {b} is a word edge, {s} white space.
DECISION = r"{b}(decided|decision|we (?:use|chose|picked|went with|will use|are using)|going with|let's use|switch(?:ed)? to|adopt(?:ed)?|standardi[sz]e on){b}"
PREFERENCE = r"{b}(prefer|favou?r|rather than|like(?:s)? using|tend to){b}"
CONSTRAINT = r"{b}(must|must not|never|always|cannot|can't|do not|don't|required|requirement|need to|has to|only allow|not allowed|forbidden){b}"
STATE = r"{b}(currently|right now|in progress|mid-|working on|wip|todo|blocked on|next step){b}"
FILLER = r"^(hi|hey|hello|yo|thanks|thank you|thx|ty|ok|okay|k|cool|great|nice|awesome|perfect|sounds good|sure|yes|yeah|yep|no|nope|got it|np|no problem|you're welcome|welcome|good morning|good afternoon|good night|gn|bye|goodbye|see you|cya|cheers|lol|lmao|haha+|hmm+|right|alright|fine|done|ok thanks|ok cool|thanks a lot|much appreciated|please|pls){b}[{s}!.,]*\z"
FILLER_PHRASE = r"{b}(let me know|feel free|no worries|talk soon|keep me posted|sounds good|thanks a lot|thank you so much|much appreciated|appreciate it|got it,? thanks|will do|on it|my bad|nvm|never ?mind){b}"
REQUEST = r"^(change|reduce|increase|give|make|add|remove|delete|fix|create|write|generate|draw|edit|crop|resize|rotate|translate|convert|build|show|tell|find|send|open|close|run|try|redo|regenerate|rephrase|rewrite|summari[sz]e|explain|describe|paraphrase|improve|enhance|update|adjust|set|turn|put|move|copy|paste|upload|download|attach|paint|color|colour){b}"


def marker(p: str, edge: str = EDGE, space: str = SPACE) -> str:
    return "(?i)" + p.replace("{b}", edge).replace("{s}", space)


def _starts(p: str) -> str:
    """The first letters of a marker's alternatives, as a class."""
    depth, found, fresh = 0, "", True
    for c in p[p.index("(") + 1 :]:
        if fresh and depth == 0:
            found += c
        fresh = c == "|" and depth == 0
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
    return f"[{''.join(sorted({*found.lower(), *found.upper()}))}]"


def has(s: Column, p: str) -> Column:
    """Whether s holds a marker. All alternatives start with a letter, so that a look at the letter, and at what stands
    before it, passes over most places."""
    quick = p.replace("{b}(", rf"(?<![A-Za-z0-9_])(?={_starts(p)})(", 1) if p.startswith("{b}(") else p
    return s.rlike(marker(quick))


def durable(s: Column) -> Column:
    return has(s, DECISION) | has(s, PREFERENCE) | has(s, CONSTRAINT)


def _kind(decision: Column, constraint: Column, preference: Column, s: Column) -> Column:
    return F.when(decision, "decision").when(constraint, "constraint").when(preference, "preference").when(has(s, STATE), "state").otherwise("fact")


def classify(s: Column) -> Column:
    return _kind(has(s, DECISION), has(s, CONSTRAINT), has(s, PREFERENCE), s)


def is_noise(text: Column) -> Column:
    return let(trim(text), lambda s: _noise(s, durable(s)))


def judgement(text: Column) -> Column:
    """(drop, kind) of a text, with its markers looked for once."""
    marks = lambda s: F.struct(s.alias("s"), has(s, DECISION).alias("d"), has(s, CONSTRAINT).alias("c"), has(s, PREFERENCE).alias("p"))
    both = lambda m: F.struct(_noise(m["s"], m["d"] | m["c"] | m["p"]).alias("drop"), _kind(m["d"], m["c"], m["p"], m["s"]).alias("kind"))
    return let(let(trim(text), marks), both)


def _noise(s: Column, lasting: Column) -> Column:
    """Of a trimmed text; lasting: whether it has a durable marker. Cheap looks at a text's first words come first."""
    three_words = at_least_words(s, 3)
    return (
        F.when((s == "") | (~at_least_alnum(s, 6) & (alnum_length(s) < 6)), True)
        .when(~three_words & s.rlike(EMOJI), True)
        .when(lasting, False)
        .when(has(s, FILLER), True)
        .when(shorter(s, 80) & has(s, FILLER_PHRASE), True)
        .when(s.endswith("?") & shorter(s, 90), True)
        .when(shorter(s, 160) & has(s, REQUEST), True)
        .otherwise(shorter(s, 12) | ~three_words)
    )


def sentences(s: Column) -> Column:
    parts = F.split(collapse(s), r"(?<=[.!?]) +(?=[A-Z0-9\"'`])", -1)
    return F.filter(F.transform(parts, trim), lambda p: p != "")


_FENCE = r"(?s)```.*?```"


def code_blocks(s: Column) -> Column:
    """Bodies of fenced blocks of 10 characters and more."""
    body = lambda b: trim(F.regexp_replace(F.regexp_replace(b, r"\A```[A-Za-z0-9_-]*\n?", ""), r"```\z", ""))
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit(_FENCE), 0), body), lambda b: length(b) >= 10)


def prose(s: Column) -> Column:
    return F.regexp_replace(s, _FENCE, " ")


def _candidate(text: Column, kind: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("kind"), confidence.cast("double").alias("confidence"))


def candidates(text: Column, kind: Column) -> Column:
    """The (text, kind, confidence) statements of an event's text and (nullable) kind, in order."""
    return let(trim(F.coalesce(text, F.lit(""))), lambda raw: _candidates(raw, kind))


def _candidates(raw: Column, kind: Column) -> Column:
    none = F.array().cast(CANDIDATE)
    tagged = kind.isNotNull() & (kind != "") & (length(raw) <= 300) & (F.size(sentences(raw)) <= 1)
    given = F.nullif(kind, F.lit(""))
    code = F.transform(code_blocks(raw), lambda b: _candidate(b, F.lit("code"), F.lit(0.8)))

    def said(s: Column) -> Column:
        k = F.coalesce(given, classify(s))
        return let(k, lambda k: _candidate(s, k, F.when(k == "fact", 0.5).otherwise(0.7)))

    kept = F.transform(F.filter(sentences(prose(raw)), lambda s: ~is_noise(s)), said)
    both = F.concat(code.cast(CANDIDATE), kept.cast(CANDIDATE))
    whole = F.array(_candidate(raw, F.coalesce(given, F.lit("fact")), F.lit(0.4))).cast(CANDIDATE)
    alone = F.array(_candidate(raw, kind, F.lit(0.9))).cast(CANDIDATE)
    rest = F.when(is_noise(raw), none).otherwise(whole)
    return F.when(raw == "", none).when(tagged, F.when(is_noise(raw), none).otherwise(alone)).otherwise(let(both, lambda found: F.when(F.size(found) > 0, found).otherwise(rest)))
