"""Text expressions. All run inside the JVM; nothing here is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of each script, in the order that breaks ties.
SCRIPTS = {
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "latin": r"A-Za-z",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "kana": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}",
}
#: The judge's score fields.
SCORE_FIELDS = ("contribution_accuracy", "contribution_coverage", "evidence_faithfulness", "evidence_self_contained", "evidence_concision", "overall")


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strip(text) -> Column:
    """Without white space (as Unicode has it) at both ends."""
    return F.regexp_replace(_column(text), r"(?U)^\s+|\s+$", "")


def clean_array(texts) -> Column:
    """Stripped texts, blank ones dropped."""
    return F.filter(F.transform(_column(texts), strip), lambda x: x != "")


def words(text) -> Column:
    """The words between white space."""
    return F.filter(F.split(_column(text), r"(?U)\s+"), lambda x: x != "")


def first_token_label(text) -> Column:
    """'yes' or 'no' if the first word is that, in any case and with stops behind it; else null."""
    first = F.lower(F.regexp_extract(strip(text), r"(?U)^(\S+)", 1))
    label = F.regexp_replace(first, r"[.,;:!?]+$", "")
    return F.when(label.isin("yes", "no"), label)


def tag_body(text, tag: str) -> Column:
    """The stripped body of the first such element; null if there is none or it is empty."""
    body = strip(F.regexp_extract(_column(text), rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return F.when(body != "", body)


def keywords_of(text) -> Column:
    """The keywords element's body, or else the whole text, stripped."""
    return F.coalesce(tag_body(text, "keywords"), strip(text))


def refused_keywords(keywords, most: int = 7) -> Column:
    """True where keywords say SKIP or are more than ``most`` words."""
    return (F.upper(strip(keywords)) == "SKIP") | (F.size(words(keywords)) > most)


def without_tags(text, tags: tuple[str, ...] = ("contribution", "evidence")) -> Column:
    return F.regexp_replace(_column(text), rf"(?i)</?(?:{'|'.join(tags)})>", "")


def judge_scores(text, fields: tuple[str, ...] = SCORE_FIELDS) -> Column:
    """A struct of all fields' scores 1 to 5 inside the scores element, or null if any is missing."""
    # bound by one-element arrays, so that each part is evaluated once
    block = F.regexp_extract(_column(text), r"(?s)<scores>(.*?)</scores>", 1)
    found = F.transform(F.array(block), lambda b: F.array(*[F.regexp_extract(b, rf"<{f}>\s*([1-5])\s*</{f}>", 1) for f in fields]))
    scores = F.transform(found, lambda v: F.when(F.forall(v, lambda x: x != ""), F.struct(*[F.when(F.get(v, F.lit(i)) != "", F.get(v, F.lit(i))).cast("int").alias(f) for i, f in enumerate(fields)])))
    return F.get(scores, F.lit(0))


def judge_reason(text) -> Column:
    """The stripped body of the reason element; null if there is none."""
    whole = r"(?s)<reason>(.*?)</reason>"
    return F.when(_column(text).rlike(whole), strip(F.regexp_extract(_column(text), whole, 1)))


def script_count(text, script: str) -> Column:
    """Characters of a script."""
    return F.length(F.regexp_replace(_column(text), f"[^{SCRIPTS[script]}]+", ""))


def dominant_script(text) -> Column:
    """The script with most characters, ties in the order of SCRIPTS; 'unknown' without any."""
    # bound by a one-element array, so that each script is counted once
    counts, names = F.array(*[F.coalesce(script_count(text, s), F.lit(0)) for s in SCRIPTS]), F.array(*map(F.lit, SCRIPTS))
    first = lambda n: F.get(names, (F.array_position(n, F.array_max(n)) - 1).cast("int"))
    return F.get(F.transform(F.array(counts), lambda n: F.when(F.array_max(n) == 0, F.lit("unknown")).otherwise(first(n))), F.lit(0))


def same_script(left, right) -> Column:
    """True where the dominant scripts agree or one is unknown; tags in the second text don't count."""
    a, b = dominant_script(left), dominant_script(without_tags(right))
    return (a == b) | (a == "unknown") | (b == "unknown")


def language(text, latin: Column | None = None) -> Column:
    """A language name from the script rules; ``latin`` decides for Latin text, English by default.

    Text without a counted character is Chinese; kana or Hangul must be more than a twentieth of all counted characters.
    """
    n = {s: F.coalesce(script_count(text, s), F.lit(0)) for s in SCRIPTS}
    asian = n["cjk"] + n["kana"] + n["hangul"]
    every = asian + n["latin"]
    return (
        F.when(every == 0, "Chinese")
        .when((asian > n["latin"]) & (n["kana"] / every > 0.05), "Japanese")
        .when((asian > n["latin"]) & (n["hangul"] / every > 0.05), "Korean")
        .when(asian > n["latin"], "Chinese")
        .otherwise(F.coalesce(latin, F.lit("English")) if latin is not None else F.lit("English"))
    )


def has_cjk(text) -> Column:
    return _column(text).rlike(r"[\x{4E00}-\x{9FFF}]")


def is_ascii(text) -> Column:
    return _column(text).rlike(r"^[\x00-\x7F]*$")


def base64_run(text) -> Column:
    """The longest run of base64 characters, 0 if none."""
    runs = F.regexp_extract_all(_column(text), F.lit("([A-Za-z0-9+/]+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def tokens(text) -> Column:
    """The default tokenizer: words of letters and digits, and each other non-space character."""
    return F.regexp_extract_all(_column(text), F.lit(r"(\w+|[^\w\s])"), 1)


def token_count(text) -> Column:
    return F.size(tokens(text))


def truncated(text, most: int) -> Column:
    """The text itself if it has at most ``most`` tokens, else what stands up to the end of the last one that is kept."""
    pieces = F.regexp_extract_all(_column(text), F.lit(r"(\s*(?:\w+|[^\w\s]))"), 1)  # tokens with the space before them
    return F.when(F.size(pieces) <= most, _column(text)).otherwise(F.array_join(F.slice(pieces, 1, most), ""))


def estimated_tokens(chars, least: int = 100) -> Column:
    return F.greatest(F.floor(_column(chars) / 3), F.lit(least))


def unquoted(text) -> Column:
    """Without one pair of double and then one pair of single quotes, stripped after each; 'none' in any case becomes empty."""
    out = strip(text)
    for quote in ('"', "'"):
        out = F.when(out.startswith(quote) & out.endswith(quote), strip(F.regexp_replace(out, f"^{quote}|{quote}$", ""))).otherwise(out)
    return F.when(F.lower(out) == "none", "").otherwise(out)


def numbered_list(text, size, allowed: list[str], default: str) -> Column:
    """One label for each of ``size`` items: lines without their numbers, unknown ones and missing ones as ``default``."""
    size = F.lit(size) if isinstance(size, int) else size
    lines = clean_array(F.split(strip(text), r"\r\n|\r|\n"))
    labels = F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), r"^[0-9.、) ]+", "")))
    known = F.transform(labels, lambda x: F.when(x.isin(*allowed), x).otherwise(F.lit(default)))
    return F.slice(F.concat(known, F.array_repeat(F.lit(default), size)), F.lit(1), size)


def rendered(template: str, **values: Column) -> Column:
    """A template with {{ name }} places filled; only names given are replaced, and filled text isn't scanned again."""
    import re

    pieces, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        if m[1] not in values:
            raise KeyError(m[1])
        pieces += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def model_name(path) -> Column:
    """What follows the first slash, or all."""
    return F.when(_column(path).contains("/"), F.regexp_replace(_column(path), "^[^/]*/", "")).otherwise(_column(path))


def safe_name(name) -> Column:
    return F.replace(F.replace(F.replace(_column(name), F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_")), F.lit(" "), F.lit("_"))


def cut_query(query, most: int) -> Column:
    """The first ``most`` characters."""
    return F.substring(_column(query), 1, most)


def instructed(query, model: str, instruction: str, models: tuple[str, ...]) -> Column:
    """The query behind an instruction, for the models that want one."""
    return F.concat(F.lit(instruction), _column(query)) if model in models else _column(query)


#: Words of an error that tell of a quota, and of its end; names of errors that tell of both.
QUOTA_WORDS = ("usage limit", "quota", "credits", "credit balance")
ENDED_WORDS = ("exceeded", "exhausted", "depleted", "limit")
QUOTA_ERRORS = ("UsageLimitExceededError", "ExaUsageLimitError")


def quota_error(message, name=None) -> Column:
    """True where an error says that a quota is used up, by its type's name or by its words."""
    low = F.lower(F.coalesce(_column(message), F.lit("")))
    anyone = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    told = anyone(QUOTA_WORDS) & anyone(ENDED_WORDS)
    return told if name is None else told | F.coalesce(_column(name).isin(*QUOTA_ERRORS), F.lit(False))


def title_text(title, text) -> Column:
    """'title text' where there is a title, else the text; null text is empty."""
    head = strip(F.coalesce(_column(title), F.lit("")))
    body = F.coalesce(_column(text), F.lit(""))
    return F.when(head != "", F.concat(head, F.lit(" "), body)).otherwise(body)
