"""Tokens, overlap scores, clean-up and tolerant JSON as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that content tokens leave out.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might must can what when where who whom which why how"
).split()

#: A Unicode word or a single sign; Java's \w is ASCII only.
METRIC_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD_TOKEN = r"[a-zA-Z0-9']+"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes, in order."""
    return F.transform(all_matches(text, WORD_TOKEN), lambda t: F.lower(t))


def content_tokens(text: Column) -> Column:
    """Words without stopwords and single characters."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words(text), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))


def metric_tokens(text: Column) -> Column:
    return F.transform(all_matches(text, METRIC_TOKEN), lambda t: F.lower(t))


def token_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits (item-level support)."""
    return F.transform(all_matches(text, r"[A-Za-z0-9]+"), lambda t: F.lower(t))


def overlap_share(query: Column, memory: Column) -> Column:
    """Share of the query's distinct tokens that the memory has; 0 if the query has none."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, memory)) / F.size(q)).otherwise(F.lit(0.0))


def lexical_score(question: Column, memory: Column) -> Column:
    return overlap_share(content_tokens(question), content_tokens(memory))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case; of the signs only the apostrophe, the backslash, and blanks between words stay."""
    return squeeze(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^a-zA-Z0-9\\s']+", " "))


def canonical_name(name: Column) -> Column:
    return F.lower(squeeze(F.coalesce(name, F.lit(""))))


def normalize_role(speaker: Column, speaker_a: Column, speaker_b: Column) -> Column:
    """user for the first speaker's name, assistant for the second's, else system or unknown; case and blanks don't matter."""
    name = canonical_name(speaker)
    return F.when(name == canonical_name(speaker_a), "user").when(name == canonical_name(speaker_b), "assistant").when(name == "system", "system").otherwise("unknown")


def first_line(text: Column) -> Column:
    """First line that isn't blank, or empty."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def answer_postprocess(text: Column) -> Column:
    """Drop a leading ``Answer:``, keep the first line that isn't blank, squeeze blanks."""
    return squeeze(first_line(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^answer\s*:\s*", "")))


def strip_thinking(text: Column) -> Column:
    """Without closed think blocks and whatever follows an open one."""
    closed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think(ing)?>.*?</think(ing)?>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think(ing)?>.*", ""))


def json_object(text: Column) -> Column:
    """The fenced JSON block of a reply, else its first ``{`` to its last ``}``; empty if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def is_stub_payload(obj: Column, required: str) -> Column:
    """A reply that says nothing: only status fields, or without the required key."""
    keys = F.coalesce(F.json_object_keys(obj), F.array().cast("array<string>"))
    status = F.array(*[F.lit(k) for k in ("status", "message", "timestamp", "error")])
    return (F.size(F.array_except(keys, status)) == 0) | ~F.array_contains(keys, required)


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def token_estimate(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(3.2).cast("double")))).cast("long")


def judge_label(label: Column, body: Column) -> Column:
    """1 or 0 of a judge's label; CORRECT is looked for first, so INCORRECT counts as 1 as in the published scores."""
    up = F.upper(F.coalesce(label, F.lit("")))
    return F.when(up.contains("CORRECT"), 1).when(up.contains("WRONG"), 0).when(F.upper(F.coalesce(body, F.lit(""))).rlike(r"\bCORRECT\b"), 1).otherwise(0)


def judge_reason(reply: Column) -> Column:
    """Reason, explanation or rationale of a judge's JSON; else what stands before the JSON."""
    obj = json_object(reply)
    named = [F.nullif(F.trim(F.get_json_object(obj, f"$.{k}")), F.lit("")) for k in ("reason", "explanation", "rationale")]
    return F.coalesce(*named, F.regexp_replace(F.regexp_extract(reply, r"(?s)^([^{]*)", 1), r"^\s+|\s+$", ""))


def join_values(values: Column) -> Column:
    """a; a and b; a, b, and c. Blank values are dropped, and so are repeats that differ in case only."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    lower = lambda a: F.transform(a, lambda v: F.lower(v))
    clean = F.filter(clean, lambda v, i: F.array_position(lower(clean), F.lower(v)) == i + 1)
    n = F.size(clean)
    head = F.array_join(F.slice(clean, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.coalesce(F.get(clean, n - 1), F.lit(""))
    return F.when(n <= 1, last).when(n == 2, F.concat_ws(" and ", clean)).otherwise(F.concat(head, F.lit(", and "), last))


def clean_value(value: Column) -> Column:
    """Slot value without edge punctuation and without what begins at the word "that"."""
    edge = F.regexp_replace(F.coalesce(value, F.lit("")), r"^[ .,:;]+|[ .,:;]+$", "")
    return F.trim(F.regexp_replace(edge, r"(?i)\bthat\b.*$", ""))


def recovered_ids(reply: Column, valid: Column, top_k: int) -> Column:
    """Memory ids named in a reply, valid ones only, in order, without repeats, at most ``top_k``."""
    return F.slice(F.array_intersect(F.array_distinct(all_matches(reply, r"\bconv\d+_session\d+\b")), valid), 1, top_k)


def last_items(items: Column, n: int | None) -> Column:
    """Last n items; by default 60, and all for zero or less."""
    n = 60 if n is None else n
    return items if n <= 0 else F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def option_letters(options: Column, answers: Column, qa_type: Column) -> Column:
    """Letters of choice answers given as ``B``, ``(b)``, ``B. text`` or an option's own text.

    Options are lettered by their own ``X.`` prefix, else by place. An answer that names none gives an empty
    result for all. A single choice gives its first letter, the other types all of them joined by commas.
    """
    named = r"^\s*([A-Z])\.\s*(.+?)\s*$"
    clean = F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: o != "")
    letters = F.transform(clean, lambda o, i: F.when(o.rlike(named), F.regexp_extract(o, named, 1)).otherwise(F.chr(i + 65)))
    bodies = F.transform(clean, lambda o: F.when(o.rlike(named), F.regexp_extract(o, named, 2)).otherwise(o))

    def one(answer):
        bare = F.upper(F.regexp_extract(answer, r"^\(?\s*([A-Za-z])\s*\)?$", 1))
        dotted = F.upper(F.regexp_extract(answer, r"^\s*([A-Za-z])\.\s*\S", 1))
        place = F.array_position(bodies, answer)
        return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(dotted, F.lit("")), F.when(place > 0, F.get(letters, (place - 1).cast("int"))))

    found = F.transform(F.filter(F.transform(answers, lambda a: F.trim(a)), lambda a: a != ""), one)
    complete = (F.size(found) > 0) & (F.size(clean) > 0) & ~F.exists(found, lambda x: x.isNull())
    return F.when(~complete, F.lit("")).when(qa_type == "single_choice", F.get(found, F.lit(0))).otherwise(F.array_join(found, ","))
