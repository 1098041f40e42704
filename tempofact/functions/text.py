"""Text functions as Column expressions; regular expressions stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A small list of frequent words by default; callers pass their own list for their language.
STOP_WORDS = "a an and are as at be but by for from has have he her his i if in is it its me my no not of on or our she so that the their them they this to was we were what when where which who will with you your".split()
MONTHS = "january february march april may june july august september october november december".split()


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tags(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of letters, digits and _ in order, lower-cased, of 2 characters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    drop = F.array(*map(F.lit, STOP_WORDS if stop is None else stop))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(drop, w)))


def token_estimate(text: Column) -> Column:
    return (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 1.3).cast("int")


def quarter_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


# The numbers whose change makes a text a newer version of the same fact, and those that topics are near to.
UNITS = r"(?:%|percent|kg|lbs?|mi(?:les)?|km|m|cm|mm|hours?|hrs?|days?|years?|yrs?|months?|weeks?|wks?|times?|x/(?:day|week|month)|/(?:day|week|month))"
MEASURE = rf"\b[\d,]+(?:\.\d+)?\s*{UNITS}\b"
SKELETON_VALUE = rf"[$€£¥]\s*[\d,]+(?:\.\d+)?\s*[kmbt]?\b|{MEASURE}"
TOPIC_VALUE = rf"[$€£¥]\s*[\d,]+(?:\.\d+)?[kmbt]?|\b\d+:\d{{2}}\b|{MEASURE}"
DATE_TAG = r"\[\d{4}-\d{2}-\d{2}[^\]]*\]"
# Suffixes of the light stem, in order.
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ied", "ed", "es", "ly", "al", "s")


def skeleton(text: Column) -> Column:
    """Lower case, dates in brackets dropped, sums of money and numbers with a unit as NUM, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(text), DATE_TAG, ""), "(?U)" + SKELETON_VALUE, "NUM"))


def stem(word: Column) -> Column:
    """Lower case without closing apostrophes and outer hyphens, and without the first suffix of the list that leaves at least four letters."""
    return without_suffix(F.regexp_replace(F.regexp_replace(F.lower(word), "'+$", ""), "^-+|-+$", ""))


def without_suffix(w: Column) -> Column:
    return reduce(lambda acc, s: F.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 4), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(acc), reversed(SUFFIXES), w)


def normalise_answer(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"\b(a|an|the)\b", " ")
    return squeeze(F.regexp_replace(t, r"[!-/:-@\[-`{-~]", ""))


def normalise_words(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def normalise_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")


def fingerprint(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"^[\s!-/:-@\[-`{-~]+", ""), r"[\s!-/:-@\[-`{-~]+$", "")
    return F.regexp_replace(t, r"\s+", " ")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the multisets of normalised words; yes and no must be equal; 0 where either is empty."""
    p, g = normalise_answer(prediction), normalise_answer(gold)
    pw, gw = words_of(p), words_of(g)
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    same = F.aggregate(F.array_distinct(gw), F.lit(0), lambda acc, w: acc + F.least(times(pw, w), times(gw, w)))
    yes_no = p.isin("yes", "no") | g.isin("yes", "no")
    f1 = 2.0 * same / (F.size(pw) + F.size(gw))
    return F.when(yes_no & (p != g), 0.0).when((F.size(pw) == 0) | (F.size(gw) == 0) | (same == 0), 0.0).otherwise(f1)


def found_share(text: Column, needles: list[str]) -> Column:
    """Share of needles in the text; 0 without needles."""
    if not needles:
        return F.lit(0.0)
    return reduce(lambda a, n: a + F.when(F.contains(F.lower(text), F.lit(n.lower())), 1).otherwise(0), needles, F.lit(0)) / len(needles)


def extract_answer(text: Column) -> Column:
    """The last bold part, else what follows "answer:", else a text or last line of at most ten words, else the text."""
    bold = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1)), F.lit(-1))
    said = F.nullif(F.regexp_extract(text, r"(?i)answer:\s*([^\n]+)", 1), F.lit(""))
    line = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(-1))
    short = lambda t: F.when(F.size(words_of(t)) <= 10, F.trim(t))
    return F.coalesce(F.trim(bold), F.trim(said), short(text), short(line), text)


# Wordings that say that there is no information; hedges such as "not sure" are no abstention.
ABSTAIN = (
    r"\bi don'?t have (that|this|the|any|enough) (information|context|info|data|knowledge|details?)\b",
    r"\bno (relevant |available |such |sufficient )?(information|context|memory|data) (is |was )?(available|provided|found|present)\b",
    r"\b(i (cannot|can'?t|am unable to|don'?t (have the )?ability to)) (answer|determine|tell|provide|recall)\b",
    r"^\s*(sorry,?\s+)?i don'?t know[\.\!\?]?\s*$",
    r"\b(insufficient|inadequate|not enough) (information|context|data|memory)\b",
    r"\bunable to (answer|determine|find|recall)\b",
    r"\b(memories?|context|information) (do(es)? not|don'?t) (contain|include|mention|reference)\b",
)


def is_abstention(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Blank, null, or one of the wordings; ``more`` adds patterns of a caller's own."""
    return reduce(lambda a, p: a | F.lower(text).rlike(p), (*ABSTAIN, *more), F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") == "")


def top1_verdict(text: Column, new: Column, old: Column) -> Column:
    a, b = F.contains(F.lower(text), F.lower(new)), F.contains(F.lower(text), F.lower(old))
    return F.when(a & b, "ambiguous").when(a, "new_wins").when(b, "stale_wins").otherwise("miss")


SECRETS = (
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[REDACTED]"), (r"(?i)(x-api-key\s*[:=]\s*)\S+", "$1[REDACTED]"),
    (r"\b(?:sk|pk|rk|ghp|gho|xoxb|xoxp|AKIA|AIza|glpat)[-_]?[A-Za-z0-9_-]{12,}", "[REDACTED]"), (r"\b([A-Z][A-Z0-9_]*_(?:KEY|TOKEN|SECRET)\s*=\s*)\S+", "$1[REDACTED]"),
    (r"(?i)\b((?:token|password|secret)\s*=\s*)\"[^\"]+\"", "$1\"[REDACTED]\""),
)


def redact(text: Column) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), SECRETS, text)


READ_ONLY = ("ls", "cat", "grep", "find", "git status", "git log", "pwd", "echo")


def tool_event(tool: Column, target: Column, output: Column) -> Column:
    """What a tool call is remembered as; null for read-only commands."""
    plain = reduce(lambda a, p: a | F.startswith(target, F.lit(p)), READ_ONLY, F.lit(False))
    return F.when(tool == "Write", F.concat(F.lit("Created file: "), target)).when(tool == "Edit", F.concat(F.lit("Edited file: "), target)).when(
        (tool == "Bash") & ~plain, F.concat(F.lit("Ran command: "), target, F.lit(" -> "), F.substring(output, 1, 200)))


FACTS = ((r"(?i)\bi (?:prefer|like|love) ([^.\n]+)", "preference"), (r"(?i)\bmy favou?rite [a-z ]+ is ([^.\n]+)", "preference"), (r"(?i)\bi work (?:at|for) ([^.\n]+)", "career"), (r"(?i)\bi live in ([^.\n]+)", "location"), (r"(?i)\bi am (?:a|an) ([^.\n]+)", "identity"))


def rule_facts(text: Column) -> Column:
    """array of (category, value): all matches of all rules, in rule order."""
    parts = []
    for pattern, category in FACTS:
        parts.append(as_facts(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), category))
    return F.concat(*parts)


def as_facts(values: Column, category: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), F.trim(v).alias("value")))


CATEGORIES = (("preference", ("prefer", "like", "love")), ("career", ("work", "job", "company")), ("location", ("live", "city", "moved")), ("technical", ("code", "python", "database")))


def infer_category(text: Column) -> Column:
    return reduce(lambda acc, c: F.when(reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w)), c[1], F.lit(False)), c[0]).otherwise(acc), reversed(CATEGORIES), F.lit("general"))


def infer_tags(text: Column) -> Column:
    return F.filter(F.array(*[F.when(reduce(lambda a, w: a | F.contains(F.lower(text), F.lit(w)), words, F.lit(False)), c) for c, words in CATEGORIES]), lambda t: t.isNotNull())


def proper_nouns(text: Column, skip: list[str], most: int = 10) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1)))
    return F.slice(F.filter(found, lambda w: ~w.isin(skip)), 1, most)


def place_kind(name: Column) -> Column:
    has = lambda ws: reduce(lambda a, w: a | F.contains(F.lower(name), F.lit(w)), ws, F.lit(False))
    return F.when(has(["city", "street", "park", "states"]), "location").when(has(["university", "company", "corp", "school"]), "organization").otherwise("person")


def strip_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<reasoning>.*?</reasoning>", ""))


def predicted_mode(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(fact|recommendation)\b", 1)), F.lit(""))


def judge_label(text: Column) -> Column:
    """The last CORRECT or WRONG; WRONG without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.upper(text), F.lit(r"\b(CORRECT|WRONG)\b"), F.lit(1)), F.lit(-1)), F.lit("WRONG"))


NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def number_word(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])
    w = F.lower(F.trim(word))
    return F.coalesce(F.try_element_at(table, w), F.when(w.rlike(r"^\d{1,9}$"), w.cast("int")))


def gold_hint(text: Column, gold: Column) -> Column:
    """How a gold answer shows in a text: as itself, by its number, by its number word, or not."""
    number = F.regexp_extract(gold, r"(\d+)", 1)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+|\d+)"), F.lit(1))
    spelled = F.exists(words, lambda w: number_word(w).cast("string") == number)
    return F.when(F.contains(F.lower(text), F.lower(gold)), "substring").when((number != "") & F.array_contains(words, number), "numeric").when((number != "") & spelled, "word").otherwise("none")


def order_match(text: Column, names: list[str]) -> Column:
    """Whether the names occur in the given order: all, none, partial, ordered or misordered."""
    at = [F.locate(n.lower(), F.lower(text)) for n in names]
    seen = reduce(lambda a, x: a + F.when(x > 0, 1).otherwise(0), at, F.lit(0))
    sorted_ = reduce(lambda a, i: a & (at[i] < at[i + 1]), range(len(at) - 1), F.lit(True))
    return F.when(seen == 0, "none").when(seen < len(names), "partial").when(sorted_, "ordered").otherwise("misordered")


def recovery(before: Column, after: Column) -> Column:
    return F.when(before & after, "kept").when(before, "lost").when(after, "recovered").otherwise("still_wrong")


SPEAKERS = {"u": "user", "user": "user", "human": "user", "a": "assistant", "ai": "assistant", "bot": "assistant", "assistant": "assistant"}


def speaker(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv]), F.lower(F.trim(name))), F.lit("user"))


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(allowed), v).otherwise(default)
