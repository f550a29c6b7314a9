"""Functions over summaries, answers and messages. All are columns; null stays null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories in order, with what a summary must contain.
SUMMARY_CATEGORIES = (
    ("crypto", "crypto|encrypt|decrypt"),
    ("network", "network|socket|connect"),
    ("authentication", "auth|login|password"),
    ("io_operations", "file|read|write"),
    ("initialization", "init|setup|constructor"),
    ("error_handling", "error|exception|handler"),
)

#: Words that are no keywords.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can this that "
    "these those and or but if then else when where which who what how why to from for with without in on at by of as it"
).split()

#: Phrases that make a line a finding of high or medium relevance.
HIGH = (
    "vulnerability", "exploit", "buffer overflow", "unsafe", "injection", "backdoor", "malware", "shellcode", "rop chain",
    "heap spray", "use after free", "double free", "stack overflow", "format string", "integer overflow", "null pointer",
    "race condition", "privilege", "escalation", "arbitrary code", "remote code execution",
)
MEDIUM = (
    "function", "address", "reference", "import", "export", "symbol", "call", "jump", "branch", "loop", "condition",
    "parameter", "return", "register", "stack", "heap", "pointer", "structure", "class", "method", "variable", "string",
    "constant", "offset", "section", "segment",
)

#: Roles by the names that occur for them.
ROLES = {"user": ("user",), "assistant": ("assistant",), "tool_call": ("tool call", "tool_call", "tool"), "tool_response": ("tool response", "tool_response"), "error": ("error",), "edited": ("edited",)}


def summary_category(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, parts in SUMMARY_CATEGORIES:
        out = F.when(low.rlike(parts), name) if out is None else out.when(low.rlike(parts), name)
    return F.when(text.isNotNull(), out.otherwise("utility"))


def keywords(text: Column, most: int = 5) -> Column:
    """The first words of more than 3 ASCII signs that are no stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9_]+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)), 1, most)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def truncated_at_line(text: Column, most: int) -> Column:
    """Cut at the last line end before `most`, if there is one, with a mark."""
    head = F.substring(text, 1, most)
    cut = F.when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(text) > most, F.concat(cut, F.lit("\n// ... [truncated]"))).otherwise(text)


def truncated_middle(text: Column, max_tokens: int) -> Column:
    """The beginning (70 %) and end (30 %) of what `max_tokens` hold, at 4 signs a token, around a mark."""
    tokens = F.floor(F.length(text) / 4)
    keep = F.floor(F.length(text) * (F.lit(float(max_tokens)) / tokens))
    head, tail = F.floor(keep * 0.7).cast("int"), F.floor(keep * 0.3).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit("\n\n[... truncated for context management ...]\n\n"), F.right(text, tail))
    return F.when(tokens > max_tokens, cut).otherwise(text)


def section(text: Column, header: str) -> Column:
    """What follows a `**Header**` (or the plain header) up to the next such line or an empty line before a header; trimmed."""
    bold = F.regexp_extract(text, rf"(?s)\*\*{header}[^*]*\*\*(.*?)(?=\n\*\*|\n\n(?:\s*\*\*|\s*[A-Z][a-z]+:)|$)", 1)
    plain = F.regexp_extract(text, rf"(?s){header}(.*?)(?=\n\*\*|\n\n(?:\s*\*\*|\s*[A-Z][a-z]+:)|$)", 1)
    found = F.trim(F.regexp_replace(F.regexp_replace(F.when(text.contains(f"**{header}"), bold).otherwise(plain), r"^\s+|\s+$", ""), r"^:\s*", ""))
    return F.when(found != "", found)


def answer_flags(security: Column, category: Column) -> Column:
    """Flags that a model's answer gives: LLM_FLAGGED unless it says that there is nothing, CATEGORY_<name>."""
    clean = F.lower(security).rlike("none|no security|not applicable")
    return F.array_compact(F.array(F.when(security.isNotNull() & ~clean, "LLM_FLAGGED"), F.when(F.length(category) > 0, F.concat(F.lit("CATEGORY_"), F.replace(F.upper(category), F.lit(" "), F.lit("_"))))))


def squeezed(text: Column) -> Column:
    """For comparisons: white space is one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def relevance(line: Column) -> Column:
    """9, 6 or 3 by the phrases in a line."""
    low = F.lower(line)
    return F.when(low.rlike("|".join(HIGH)), 9).when(low.rlike("|".join(MEDIUM)), 6).otherwise(3)


def similar_tasks(a: Column, b: Column) -> Column:
    """Equal without case and punctuation, one within the other, or at least 70 % common words of over 2 signs."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))
    x, y = plain(a), plain(b)
    u, v = F.split(x, r"\s+"), F.split(y, r"\s+")
    common = F.size(F.filter(u, lambda w: (F.length(w) > 2) & F.array_contains(v, w)))
    return F.coalesce(x.contains(y) | y.contains(x) | (common / F.greatest(F.size(u), F.size(v)) >= 0.7), F.lit(False))


def role(name: Column) -> Column:
    """The usual name of a role; `unknown` for none."""
    low, out = F.trim(F.lower(name)), None
    for usual, forms in ROLES.items():
        out = F.when(low.isin(*forms), usual) if out is None else out.when(low.isin(*forms), usual)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "unknown").otherwise(out.otherwise(low))


def role_title(name: Column) -> Column:
    """A role as a heading: words with capitals for the usual ones, else the first sign alone."""
    usual = role(name)
    known = F.initcap(F.replace(usual, F.lit("_"), F.lit(" ")))
    other = F.concat(F.upper(F.substring(usual, 1, 1)), F.substring(usual, 2, 1 << 20))
    return F.when(usual == "unknown", "Unknown").when(usual.isin(*ROLES), known).otherwise(other)


def snippet(text: Column, query: str, size: int = 500) -> Column:
    """`size` signs around the first hit of any of the query's terms (split at blanks), with dots where it was cut."""
    low = F.lower(text)
    places = [F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in query.lower().split(" ") if t]
    best = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.length(text)) if places else F.lit(0)
    start = F.greatest(F.lit(0), best - size // 2)
    end = F.least(F.length(text), start + size)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))


def clean_json(answer: Column) -> Column:
    """The JSON in a model's answer, mended where that is known to help; null for null.

    What a fence of back ticks or quotes holds; else the answer without the quotes around all of it, if JSON remains. JSON that parses with
    escaped quotes in it stays as it is; otherwise they lose their backslash. Escaped white space becomes white space,
    and an object that stands in quotes in another loses these.
    """
    text = F.trim(answer)
    fence = r"(?s)^[`']{3}(?:\w+)?\s*(.*?)\s*[`']{3}$"
    inner = F.trim(F.substring(text, 2, F.length(text) - 2))
    quoted = (F.length(text) > 1) & (text.rlike(r'(?s)^".*"$') | text.rlike(r"(?s)^'.*'$"))
    bare = F.when(text.rlike(fence), F.trim(F.regexp_extract(text, fence, 1))).when(quoted & F.try_parse_json(inner).isNotNull(), inner).otherwise(text)
    escaped = F.contains(bare, F.lit('\\"'))
    mended = F.when(escaped, F.replace(bare, F.lit('\\"'), F.lit('"'))).otherwise(bare)
    for sign, plain in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), (':"{"', ':{"'), ('"}"}', '"}}')):
        mended = F.replace(mended, F.lit(sign), F.lit(plain))
    return F.when(escaped & F.try_parse_json(bare).isNotNull(), bare).otherwise(mended)


def json_items(json: Column) -> Column:
    """The elements of a JSON array as JSON texts, or the one value; null where it doesn't parse."""
    listed = F.from_json(json, "array<string>")
    return F.when(F.try_parse_json(json).isNotNull(), F.when(F.ltrim(json).startswith("["), listed).otherwise(F.array(json)))


def json_of_answer(text: Column) -> Column:
    """The JSON in a model's answer: what is within a code fence, else between the outer braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def search_words(query: str) -> list[str]:
    """The words of a full-text query: AND, OR, NOT and asterisks go."""
    words = [w.replace("*", "") for w in query.split() if w.upper() not in ("AND", "OR", "NOT")]
    return [w for w in words if w]


def edited_messages(markdown: Column) -> Column:
    """(chunk_id, role, content) of each message in an edited chat, an array in order.

    A message follows its mark `<!-- CHUNK:id -->`; its first line that begins with a heading or word gives the role and is
    no part of the content. Rules at the end go, messages without a content are left out. No marks, no messages.
    """
    mark = "<!-- CHUNK:([^>]+) -->"
    parts = F.slice(F.split(markdown, mark, -1), 2, 1 << 30)
    pairs = F.arrays_zip(F.regexp_extract_all(markdown, F.lit(mark), F.lit(1)).alias("id"), parts.alias("part"))
    head = r"(?:\A|\n)[ \t]*#{0,3}[ \t]*(\w+)[^\n]*"

    def message(x: Column) -> Column:
        body = F.regexp_extract(x["part"], "(?s)" + head + r"\n(.*)\z", 2)
        body = F.regexp_replace(F.regexp_replace(body, r"\A\s+|\s+\z", ""), r"(?:\s*---)+\z", "")
        return F.struct(x["id"].alias("chunk_id"), role(F.regexp_extract(x["part"], head, 1)).alias("role"), F.regexp_replace(body, r"\s+\z", "").alias("content"))

    return F.filter(F.transform(pairs, message), lambda m: (m["content"] != "") & (m["role"] != "unknown"))


def result_block(file: Column, chunk: Column, score: Column, snippet_: Column) -> Column:
    """A search result as it goes into a prompt."""
    return F.concat(
        F.lit("<result>\n</br><file>"), file, F.lit("</file>\n</br><chunkid>"), chunk.cast("string"), F.lit("</chunkid>\n</br><score>"), score.cast("string"),
        F.lit("</score>\n</br><content>\n"), snippet_, F.lit("\n</content>\n\n</result>\n\n"),
    )


def context_block(results: Column, query: Column) -> Column:
    """A prompt with its results (an array of result_block, in order) before the query; the query alone without any."""
    return F.when(F.size(results) > 0, F.concat(F.lit("<context>\n"), F.array_join(results, ""), F.lit("\n</context>\n"), query)).otherwise(query)


def global_context(summary: Column, content: Column, flags: Column, n_functions: Column, n_nodes: Column, n_edges: Column) -> Column:
    """A binary in words: summary, content, flags and the size of its graph; parts that are missing are left out."""
    part = lambda title, c: F.coalesce(F.when(F.length(c) > 0, F.concat(F.lit(title), c, F.lit("\n\n"))), F.lit(""))
    number = lambda title, c: F.concat(F.lit(title), c.cast("string"), F.lit("\n"))
    return F.concat(
        F.lit("## Binary Context\n\n"), part("**Summary:** ", summary), part("", content), part("**Security Flags:** ", F.array_join(flags, ", ")),
        F.lit("**Graph Statistics:**\n"), number("- Functions: ", n_functions), number("- Total nodes: ", n_nodes), number("- Total edges: ", n_edges),
    )


def reflection(answer: Column) -> Column:
    """(assessment, decision, reason, to_add, to_remove) of an agent's reflection in markdown lines.

    The last line of each kind counts. The decision is READY or CONTINUE; without one it is told by the beginning of the
    answer or by `READY:`. Tasks stand between plan updates and decision; `None` is no task. A null answer gives null.
    """
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(x))
    last = lambda title: F.trim(F.substring(F.try_element_at(F.filter(lines, lambda x: x.startswith(title)), F.lit(-1)), len(title) + 1, 1 << 30))
    updates = F.array_position(F.transform(lines, lambda x: F.when(x.startswith("**Plan Updates:**"), "u").otherwise("")), "u")
    decided = F.array_position(F.transform(lines, lambda x: F.when(x.startswith("**Decision:**"), "d").otherwise("")), "d")
    end = F.when(decided > updates, decided).otherwise(F.size(lines) + 1)
    plan = F.when(updates > 0, F.slice(lines, F.greatest(updates, F.lit(1)).cast("int"), (end - updates).cast("int"))).otherwise(F.array().cast("array<string>"))

    def tasks(word: str) -> Column:
        found = F.filter(plan, lambda x: x.rlike(f"^- ?{word}:"))
        return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, rf"^-\s*{word}:\s*", ""))), lambda t: (t != "") & (F.lower(t) != "none"))

    decision, whole = F.upper(last("**Decision:**")), F.upper(answer)
    ready = F.when(decision.isNotNull(), decision.contains("READY") & ~decision.contains("NOT READY")).otherwise(whole.contains("READY:") | whole.startswith("READY"))
    legacy = F.when(ready, "Ready to synthesize (legacy format)").otherwise("Continue investigation (legacy format)")
    assessment = F.when(decision.isNull(), legacy).otherwise(last("**Assessment:**"))
    found = F.struct(assessment.alias("assessment"), F.when(ready, "READY").otherwise("CONTINUE").alias("decision"), last("**Reason:**").alias("reason"), tasks("ADD").alias("to_add"), tasks("REMOVE").alias("to_remove"))
    return F.when(answer.isNotNull(), found)
