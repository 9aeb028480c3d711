"""Text expressions: normalisation, tokens, n-grams, phrase extraction, ids.

Everything is a Column expression, so it stays in the JVM and can be pruned,
pushed and fused with its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "for", "from", "had", "has",
    "have", "how", "if", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their",
    "them", "to", "was", "what", "when", "where", "which", "who", "why", "with", "would", "you", "your",
)
DISCOURSE_PREFIXES = ("yes, ", "no, ", "actually, ", "actually,", "so the answer is ", "the answer is ")
FORBIDDEN_ANSWER_PATTERNS = (
    r"\b(?:steam|stream)\s+of\s+consciousness\b",
    r"\bstep\s*1\b",
    r"\bstep[- ]by[- ]step\b",
    r"\blet['’]?s\s+(?:think|do|give|answer|work)\b",
    r"\bto answer (?:the|this)\b",
    r"\bavailable choices\b",
    r"\bsingle-select problem\b",
    r"\bwhich one of the following\b",
)
QUOTED_PHRASE = r'"([^"]{3,})"'
CAPITAL_PHRASE = r"\b(?:[A-Z][A-Za-z0-9'\-]+(?:\s+[A-Z][A-Za-z0-9'\-]+){0,3})\b"
WORD = r"[A-Za-z0-9']+"
LIST_OF_LISTS = r"(?s)\[\s*\[.*?\]\s*\]"
ENTITIES_PREFIX = r"(?i)^entities\s*:\s*"
TERMINAL_MARKS = (".", "?", "!", "。", "؟", "！", "？")
PROMPT_TEMPLATE = "Answer the following question in a single brief but complete sentence.\nQuestion: %s\nAnswer:"
MAX_ENTITIES = 8
#: A word in single quotes, and the marks of a literal that JSON writes otherwise.
LITERAL_STRING = r"'([^'\"\\]*)'"
LITERAL_MARKS = ((r'\(\s*(?=")', "["), (r'(?<=")\s*,?\s*\)', "]"), (r'(?<="),\s*\]', "]"), (r"\bNone\b", "null"))
#: White space beyond ASCII, which engines' \s leaves out.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]"


def collapse(text: Column, lower: bool = False) -> Column:
    """White space collapsed and trimmed."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(out) if lower else out


def normalize_term(text: Column) -> Column:
    """Lower case, single spaces, only a-z 0-9 ' - and space."""
    return F.trim(F.regexp_replace(collapse(F.lower(text)), r"[^a-z0-9'\- ]+", ""))


def normalize_response(text: Column) -> Column:
    """Lower case, everything but letters and digits of ASCII to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def word_set(text: Column) -> Column:
    """Distinct lower-case tokens of a-z0-9 in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != ""))


def word_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits and apostrophes."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def space_tokens(text: Column) -> Column:
    """Runs without white space, Unicode's included."""
    return F.regexp_extract_all(F.regexp_replace(text, WIDE_SPACE, " "), F.lit(r"\S+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by a space; none for shorter token lists. Words are picked one by one: a slice would copy the whole list each time."""
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    grams = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def overlap_match(sample: Column, candidate: Column, threshold: float = 0.5) -> Column:
    """Jaccard of word sets at the threshold, or one normalised text within the other; never for a sample without words."""
    s, c = collapse(sample, lower=True), collapse(candidate, lower=True)
    inside = (c != "") & (s != "") & (s.contains(c) | c.contains(s))
    return F.coalesce((F.size(word_set(sample)) > 0) & ((jaccard(word_set(sample), word_set(candidate)) >= threshold) | inside), F.lit(False))


def dedup_ignoring_case(values: Column) -> Column:
    """Keeps the first spelling of each value; blanks go."""
    clean = F.filter(F.transform(values, lambda v: collapse(v)), lambda v: v.isNotNull() & (v != ""))
    return F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)


def gold_candidates(*lists: Column) -> Column:
    """The union of scalar and list answers (scalars as one-element arrays), first spelling kept."""
    return dedup_ignoring_case(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def phrase_candidates(text: Column) -> Column:
    """Entities by rule: quoted phrases, capitalised runs, long words; normalised, distinct, at most eight."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED_PHRASE), F.lit(1))
    capital = F.regexp_extract_all(text, F.lit(CAPITAL_PHRASE), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    long_words = F.slice(F.filter(word_tokens(text), lambda t: (F.length(t) >= 5) & ~F.array_contains(stop, t)), 1, 2 * MAX_ENTITIES)
    terms = F.transform(F.concat(quoted, capital, long_words), normalize_term)
    return F.slice(F.array_distinct(F.filter(terms, lambda t: (t != "") & ~F.array_contains(stop, t))), 1, MAX_ENTITIES)


def merge_entities(first: Column, second: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(first, second)), 1, MAX_ENTITIES)


def strip_discourse(text: Column) -> Column:
    """Without the first matching discourse prefix."""
    return F.trim(F.regexp_replace(text, "(?i)^(" + "|".join(p.replace(",", "\\,") for p in DISCOURSE_PREFIXES) + ")", ""))


def normalize_entities(values: Column) -> Column:
    """Terms without a leading article, distinct, in order."""
    bare = F.transform(values, lambda v: F.regexp_replace(normalize_term(v), "^(a |an |the )", ""))
    return F.array_distinct(F.filter(bare, lambda v: v.isNotNull() & (v != "")))


def _json_list(body: Column) -> Column:
    """array<array<string>> from a JSON list of lists or of strings (a list of one each); null for anything else."""
    outer = F.from_json(body, "array<string>")
    inner = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    clean = lambda t: F.transform(F.filter(t, lambda v: v.isNotNull()), lambda v: F.trim(v))
    lists = F.transform(F.filter(outer, lambda x: x.isNotNull()), lambda x: clean(inner(x)))
    return F.when(F.ltrim(body).startswith("["), F.filter(lists, lambda t: t.isNotNull()))


def _as_json(literal: Column) -> Column:
    """Lists and tuples of quoted words as another language writes them, in JSON."""
    out = F.regexp_replace(literal, LITERAL_STRING, '"$1"')
    for pattern, put in LITERAL_MARKS:
        out = F.regexp_replace(out, pattern, put)
    return out


def parse_triplets(text: Column) -> Column:
    """array<array<string>> from a model's answer: JSON, else a literal with single quotes or tuples, else the first list of lists within other text; null when there is none."""
    body = F.regexp_replace(F.trim(text), ENTITIES_PREFIX, "")
    part = F.regexp_extract(body, LIST_OF_LISTS, 0)
    return F.coalesce(_json_list(body), _json_list(_as_json(body)), _json_list(part), _json_list(_as_json(part)))


def triplet_entities(triplets: Column, role: Column) -> Column:
    """The first slot for questions; first and third for statements that have three."""
    full = F.filter(triplets, lambda t: F.size(t) > 0)
    return F.flatten(F.transform(full, lambda t: F.when((role != "question") & (F.size(t) >= 3), F.array(F.get(t, F.lit(0)), F.get(t, F.lit(2)))).otherwise(F.array(F.get(t, F.lit(0))))))


def has_tagged_answer(text: Column, opening: str = "<answer>", closing: str = "<context>") -> Column:
    return F.regexp_like(text, F.lit(rf"(?s){opening}\s*(.*?)\s*{closing}"))


def tagged_answer(text: Column, opening: str = "<answer>", closing: str = "<context>", fallback: int = 80) -> Column:
    """What stands between two tags, else the first characters."""
    found = F.regexp_extract(text, rf"(?s){opening}\s*(.*?)\s*{closing}", 1)
    return F.trim(F.when(found != "", found).otherwise(F.substring(text, 1, fallback)))


def prompt_text(question: Column) -> Column:
    return F.format_string(PROMPT_TEMPLATE, F.trim(question))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-"), r"[^\p{L}\p{N}\-]", "")


def stable_id(*parts: Column) -> Column:
    """Readable slug and twelve digits of SHA-1."""
    tail = F.substring(F.sha1(F.concat_ws("::", *parts).cast("binary")), 1, 12)
    head = F.concat_ws("-", *[F.when(p != "", slug(p)) for p in parts])
    return F.when(head != "", F.concat_ws("-", head, tail)).otherwise(tail)


def prompt_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def item_seed(seed: Column, prompt_id: Column, index: Column) -> Column:
    """A 32-bit seed for each item."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", seed, prompt_id, index).cast("binary")), 1, 8), 16, 10).cast("long")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(" && ", F.least(a, b), F.greatest(a, b))


def answer_span(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "\n", 2), 1))


def has_terminal_mark(text: Column) -> Column:
    return F.array_contains(F.transform(F.array(*[F.lit(m) for m in TERMINAL_MARKS]), lambda m: F.contains(text, m)), True)


def to_bool(text: Column) -> Column:
    """true/1/yes and false/0/no; null for anything else."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def answer_only_problems(text: Column, token_ids: Column, finish: Column, max_tokens: int) -> Column:
    """Names of the answer-only rules a response breaks."""
    rules = [
        ("empty", F.trim(text) == ""),
        ("newline", text.contains("\n")),
        ("too_long", F.size(token_ids) > max_tokens),
        ("finish_reason", ~finish.isin("eos", "newline", "punctuation", "max_new_tokens")),
        ("max_new_tokens", finish == "max_new_tokens"),
        *[(f"forbidden_{i}", text.rlike("(?i)" + p)) for i, p in enumerate(FORBIDDEN_ANSWER_PATTERNS)],
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def fixed(value: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))
