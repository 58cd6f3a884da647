"""Text normalisers and extractors as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that plain-text conversion decodes, in the order it decodes them.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
SILENT_TAGS = "script style noscript svg nav footer".split()
BLOCK_TAGS = "p br div li h1 h2 h3 h4 h5 tr section article blockquote".split()
MAX_CITATIONS, MAX_REFERENCE = 32, 1000


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """For comparison without regard to the case of A-Z; other letters are told apart, as the store does."""
    return F.translate(c, _UPPER, _LOWER)


def fold_text(value: str) -> str:
    """fold() of a constant."""
    return value.translate(str.maketrans(_UPPER, _LOWER))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters they have without them."""
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


_MARKED, _PLAIN = _plain_letters()


def unaccented(c: Column) -> Column:
    """Without the marks of Latin letters, be they part of a letter or behind it."""
    marked = F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[\u0300-\u036F]+", "")
    return F.when(F.octet_length(c) != F.char_length(c), marked).otherwise(c)  # most texts have ASCII alone


def unaccented_text(value: str) -> str:
    """unaccented() of a constant."""
    return "".join(x for x in value.translate(str.maketrans(_MARKED, _PLAIN)) if not "\u0300" <= x <= "\u036f")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, without accents."""
    return F.filter(F.split(unaccented(F.lower(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrase(c: Column, words: list[str]) -> Column:
    """The words occur as tokens, one right behind the other."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_start(c: Column, value: str) -> Column:
    """Some word (after a blank or at the start) begins with ``value``."""
    return fold(c).startswith(fold_text(value)) | fold(c).contains(" " + fold_text(value))


def sentences(c: Column) -> Column:
    """Split after . ? ! where a blank and an ASCII capital follow."""
    return F.filter(F.transform(F.split(c, r"(?<=[.?!]) (?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


# Abbreviations whose stop ends no sentence, and what may close a sentence behind its stop.
ABBREVIATIONS = "mr mrs ms dr prof fig eq sec vs etc al e.g i.e".split()
_CLOSING = r"[.!?”’\"')\]}]"


def plausible_sentences(c: Column) -> Column:
    """The sentences of a paragraph that read like some.

    A sentence ends with . ! or ? and what closes it, before a blank or the end; a stop behind an abbreviation or a single letter ends none. What is left
    at the end is one too. Kept are those without @, with five letters, letters being 45 of 100 signs, and two words, or four without an end.
    """
    short = "|".join(re.escape(a) for a in ABBREVIATIONS)
    stop = rf"(?<!(?:^|\s)[^\p{{L}}\p{{N}}.\s]{{0,8}}(?:(?i:{short})|[A-Za-z])[^\p{{L}}\p{{N}}.\s]{{0,8}})\."
    end = rf"(?:{stop}|[!?]){_CLOSING}*+(?=\s|\z)"
    # whole runs at a time, and no step is ever taken back: only at . ! ? is an end looked for, only behind blanks the text's
    found = F.regexp_extract_all(c, F.lit(rf"(?=\S)(?:[^.!?\s]++|\s++(?!\z)|(?!{end})[.!?])*+(?:{end}|(?=\s*+\z))"), F.lit(0))
    letters = lambda x: F.char_length(F.regexp_replace(x, r"[^\p{L}]++", ""))
    words = lambda x: F.regexp_count(x, F.lit(r"(?<!\S)[^\s\p{L}]*+\p{L}\S*+"))
    ended = lambda x: x.rlike(r"[.!?][”’\"')\]}]*$")

    def plausible(x: Column) -> Column:
        visible = F.char_length(F.regexp_replace(x, r"\s++", ""))
        return ~x.contains("@") & (letters(x) >= 5) & (letters(x) * 100 >= visible * 45) & (words(x) >= F.when(ended(x), 2).otherwise(4))

    return F.filter(found, plausible)


def html_to_text(c: Column) -> Column:
    """Text of a page: silent elements go with what they hold, block tags break lines, other tags go, entities are decoded (``&amp;lt;`` twice).

    A tag is known by the beginning of its name, and ends at the first ``>``; one that doesn't end takes the rest along.
    """
    silent = "|".join(rf"<{t}.*?</{t}" for t in SILENT_TAGS)
    out = F.regexp_replace(c, rf"(?is)(?:{silent})[^>]*(?:>|$)|(<[^>]*>)", "$1")
    out = F.regexp_replace(out, "<[^>]*$", "")
    # of a block tag its < stays for the line break, of others nothing
    out = F.replace(F.regexp_replace(out, rf"(?i)(<)/*(?:{'|'.join(BLOCK_TAGS)})[^>]*>|<[^>]*>", "$1"), F.lit("<"), F.lit("\n"))
    return reduce(lambda o, e: F.replace(o, F.lit(e[0]), F.lit(e[1])), ENTITIES, out)


def text_lines(c: Column) -> Column:
    """The lines of a text with blanks drawn together, but for those without a letter or digit."""
    return F.filter(F.transform(F.split(c, "\n"), squeeze), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def dehyphenate(c: Column) -> Column:
    """Join words that a line end has split."""
    return F.regexp_replace(c, r"-\n(?=[a-z])", "")


def is_heading(c: Column) -> Column:
    """A short line that doesn't end like a sentence."""
    return (F.char_length(c) < 80) & (F.char_length(F.trim(c)) > 0) & ~F.trim(c).rlike(r"[.,;:]$")


# What a year and a surname look like in citations.
_YEAR = r"\(?((?:19|20)[0-9]{2}[a-z]?)\)?"
_SURNAME = r"((?:(?:van|von|de|der|den|del|della|di|la|le|du|ten|ter) )*\p{Lu}[\p{L}'’-]+)"


def entry_key(c: Column) -> Column:
    """(first, year) of a reference entry that begins with its authors: the first surname with its particles, folded, and the year, looked for in
    the first 300 letters, where authors stand. ``operators.bibliography.author_year`` tells surnames without particles and second authors."""
    first = F.lower(F.regexp_extract(c, rf"^\s*{_SURNAME}", 1))
    year = F.regexp_extract(F.substring(c, 1, 300), rf"(?<![\p{{L}}\p{{N}}]){_YEAR}(?![\p{{L}}\p{{N}}])", 1)
    return F.when((first != "") & (year != ""), F.struct(first.alias("first"), year.alias("year")))


def author_year_citations(c: Column) -> Column:
    """(first, year) of every citation such as ``(Smith & Lee, 2020a; Koch 1999)`` or ``Smith et al. (2020)``, in order within each kind."""
    name = rf"{_SURNAME}(?:(?:,| and| &| et al\.?| und| y| et)[ ]?(?:\p{{Lu}}[\p{{L}}'’-]+)?)*"
    inside = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]{4,260})\)"), F.lit(1)), lambda x: F.split(x, ";")))
    pattern = rf"{name},? ?(?<![0-9])((?:19|20)[0-9]{{2}}[a-z]?)(?![0-9])"
    found = F.transform(inside, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("first"), F.regexp_extract(x, pattern, 2).alias("year")))
    told = rf"({name} ?\((?:19|20)[0-9]{{2}}[a-z]?\))"
    narrative = F.transform(
        F.regexp_extract_all(c, F.lit(told), F.lit(1)),
        lambda x: F.struct(F.lower(F.regexp_extract(x, rf"^{_SURNAME}", 1)).alias("first"), F.regexp_extract(x, r"\(([0-9]{4}[a-z]?)\)$", 1).alias("year")),
    )
    return F.filter(F.concat(found, narrative), lambda k: (k["first"] != "") & (k["year"] != ""))


def excerpt(c: Column, limit: int) -> Column:
    """The beginning of a text, cut at a blank, with an ellipsis."""
    clean = squeeze(c)
    head = F.substring(clean, 1, limit)
    at_blank = F.regexp_extract(head, r"^(.*) ", 1)
    return F.when(F.char_length(clean) <= limit, clean).otherwise(F.concat(F.when(at_blank != "", at_blank).otherwise(head), F.lit("…")))


def doi(c: Column) -> Column:
    """The first DOI, lower-cased, without trailing punctuation; null if none. Blanks, quotes and angle brackets end it."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"""(10\.[0-9]{4,9}/[^ \t\n\f\r<>"']+)"""), F.lit(1))
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:)\]}]+$", ""))
    return F.try_element_at(F.filter(trimmed, lambda x: x.rlike("/.")), F.lit(1))


def citation_groups(c: Column) -> Column:
    """The bracketed parts of a text."""
    return F.regexp_extract_all(c, F.lit(r"(\[[^\[\]]*\]|\([^()]*\))"), F.lit(1))


def citation_numbers(c: Column, most: int = MAX_CITATIONS) -> Column:
    """The numbers of a grouped citation such as ``[20, 22-24]``; null unless all of it is numbers and ranges and two differ.

    A range that runs backwards, a number of 0 or over ``MAX_REFERENCE``, or more than ``most`` numbers reject the whole.
    """

    def inner(clean: Column) -> Column:
        return F.when(clean.rlike(r"^(\[.*\]|\(.*\))$"), F.substring(clean, 2, F.char_length(clean) - 2)).when(~clean.rlike(r"^[\[(]|[\])]$"), clean)

    well_formed = lambda parts: F.forall(parts, lambda x: x.rlike(r"^[0-9]{1,9}( ?[-–—] ?[0-9]{1,9})?$"))
    number = lambda x: x.try_cast("int")
    # of a well-formed part: what stands before the dash, and behind it
    ends = lambda x: F.split(F.translate(x, "–— ", "--"), "-")
    span = lambda e: F.struct(number(F.get(e, 0)).alias("lo"), number(F.coalesce(F.get(e, 1), F.get(e, 0))).alias("hi"))
    bounded = lambda ranges: F.forall(ranges, lambda r: (r["lo"] >= 1) & (r["hi"] >= r["lo"]) & (r["hi"] <= MAX_REFERENCE) & (r["hi"] - r["lo"] < most))
    distinct = lambda ranges: F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"]))))
    few = lambda numbers: F.when(F.size(numbers).between(2, most), numbers)
    expanded = lambda ranges: F.when(bounded(ranges), _once(distinct(ranges), few))
    spans = lambda parts: F.transform(parts, lambda x: _once(ends(x), span))
    listed = lambda parts: F.when(well_formed(parts), _once(spans(parts), expanded))
    parts = lambda x: F.transform(F.split(F.translate(x, ";", ","), ",", -1), lambda p: F.trim(F.regexp_replace(p, r"\s++", " ")))
    clean = F.regexp_replace(c, r"^[\s.:,;†*]+|[\s.:,;†*]+$", "")
    return _once(clean, lambda k: _once(inner(k), lambda x: _once(parts(x), listed)))


def _once(c: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used in there."""
    return F.get(F.transform(F.array(c), then), 0)


def page_links(c: Column) -> Column:
    """(position, target) of every link of an HTML page, in order."""
    found = F.regexp_extract_all(c, F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    return F.transform(found, lambda x, i: F.struct(i.alias("position"), x.alias("target")))


def note_links(c: Column, scheme: str) -> Column:
    """(kind, id, anchor) of Markdown links of the form ``scheme://kind/id#anchor``."""
    whole = F.regexp_extract_all(c, F.lit(rf"\]\(({scheme}://[^)\s]+)\)"), F.lit(1))
    part = lambda x, k: F.regexp_extract(x, rf"^{scheme}://([a-z]+)/([^#]+)(?:#(.*))?$", k)
    return F.filter(F.transform(whole, lambda x: F.struct(part(x, 1).alias("kind"), part(x, 2).alias("id"), part(x, 3).alias("anchor"))), lambda s: s["kind"] != "")


def highlight(c: Column, words: list[str]) -> Column:
    """Whole words of a query in double brackets."""
    if not words:
        return c
    either = "|".join(rf"\Q{w}\E" for w in words)
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", "[[$1]]")


def snippet(c: Column, words: list[str], size: int = 28) -> Column:
    """About ``size`` words round the first hit, hits marked, with ellipses where text was left out."""
    parts = F.split(squeeze(c), " ")
    bare = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"[^\p{L}\p{N}]+", "")))
    hits = F.filter(F.transform(bare, lambda p, i: F.when(p.isin([w.lower() for w in words]), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(0))
    start = F.greatest(F.lit(0), F.least(first - size // 4, F.size(parts) - size))
    body = F.array_join(F.slice(parts, start + 1, size), " ")
    body = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + size < F.size(parts), "…").otherwise(""))
    return highlight(body, words)


def topic_id(c: Column) -> Column:
    """D, F, S or T and the number, of a topic URL."""
    kind = F.regexp_extract(c, r"/(domains|fields|subfields|T)/?(\d+)$", 1)
    number = F.regexp_extract(c, r"/(domains|fields|subfields|T)/?(\d+)$", 2)
    return F.when(kind == "domains", F.concat(F.lit("D"), number)).when(kind == "fields", F.concat(F.lit("F"), number)).when(kind == "subfields", F.concat(F.lit("S"), number)).when(kind == "T", F.concat(F.lit("T"), number))


def abstract_text(index: Column) -> Column:
    """Text of an inverted-index abstract: a map of word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")


def markdown_kind(line: Column) -> Column:
    """The kind of block that a Markdown line belongs to."""
    return (
        F.when(line.rlike(r"^#{1,6} "), "heading")
        .when(line.rlike(r"^\s*(```|~~~)"), "fence")
        .when(line.rlike(r"^\s*([-*+]|\d+[.)]) "), "list")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(line.rlike(r"^\s*>"), "quote")
        .when(line.rlike(r"^( {4}|\t)\S"), "code")
        .when(F.trim(line) == "", "blank")
        .otherwise("text")
    )


def fuzzy_match(c: Column, query: str) -> Column:
    """The query's letters occur in this order."""
    return fuzzy_score(c, query) >= 0


def fuzzy_score(c: Column, query: str) -> Column:
    """How well a text fits what was typed, more is better, -1 not at all: its beginning, a word's beginning, anywhere, or its letters in
    order, where each that follows right behind the one before counts 6 and any other 1."""
    t, q = F.lower(c), query.lower()
    if not q:
        return F.when(c.isNotNull(), 0)
    at = lambda s: F.locate(s, t) - 1
    walk = F.aggregate(
        F.array(*map(F.lit, q)),
        F.struct(F.lit(0).alias("score"), F.lit(0).alias("last")),  # last: places from 1
        lambda s, x: F.when(s["score"] < 0, s).otherwise(_walked(s, F.call_function("locate", x, t, s["last"] + 1))),
        lambda s: s["score"],
    )
    return F.when(t.startswith(q), 1000 - F.char_length(t)).when(at(" " + q) >= 0, 800 - at(" " + q)).when(at(q) >= 0, 600 - at(q)).otherwise(walk)


def _walked(state: Column, found: Column) -> Column:
    gain = F.when(found == state["last"] + 1, 6).otherwise(1)
    return F.when(found == 0, F.struct(F.lit(-1).alias("score"), F.lit(0).alias("last"))).otherwise(F.struct((state["score"] + gain).alias("score"), found.alias("last")))


def positions(c: Column, query: str) -> Column:
    """Where (from 1) a text holds ``query``, regardless of A-Z case, hits not overlapping."""
    parts = F.split(fold(c), rf"\Q{fold_text(query)}\E", -1)
    return _starts(parts, len(query))


# Blanks, signs that a search passes over, and bounds of a search.
_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PASSED = r"[\x{0}\x{AD}]*"
_BLANK = {*map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}
MAX_HITS, MAX_QUERY, CONTEXT = 20_000, 256, 28


def search_pattern(query: str) -> str:
    """A regular expression for the places that read like ``query``: letters in either case, any run of blanks for a blank, and between
    any two signs soft hyphens and zero signs. Hits of it are places in the text itself, so nothing has to be mapped back."""
    out, n = [], 0
    for sign in query.replace("\0", "").replace("\xad", ""):
        if sign in _BLANK:
            if out and out[-1] is None:
                continue
            out.append(None)
        else:
            out += sign.lower()
        n = len(out)
    if not n:
        raise ValueError("the search query is empty")
    if n > MAX_QUERY:
        raise ValueError(f"the search query has more than {MAX_QUERY} signs")
    pieces = []
    for i, sign in enumerate(out):
        if sign is None:
            pieces.append(rf"{_BLANKS}(?:{_PASSED}{_BLANKS})*")
            continue
        upper = {u for u in {sign.upper(), sign.title(), *_FOLDED.get(sign, ())} if len(u) == 1 and u.lower() == sign}
        pieces.append("[" + "".join(rf"\x{{{ord(u):X}}}" for u in sorted({sign, *upper})) + "]")
    return _PASSED.join(pieces)


#: Letters by what they are in lower case, where that isn't found by going to upper case and back.
_FOLDED = {"k": ("\u212a",), "å": ("\u212b",), "ω": ("\u2126",)}


def find_exact(c: Column, query: str, most: int = MAX_HITS) -> Column:
    """array<struct<start, end>> (from 0, end included) of the places that read like ``query``, from the left, not overlapping, at most ``most``."""
    pattern = search_pattern(query)
    between, hits = F.split(c, pattern, most + 1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.slice(hits, 1, most), lambda h: F.char_length(h))
    return F.transform(
        F.zip_with(F.slice(_starts_by(between, sizes), 1, most), sizes, lambda a, n: F.struct(a.alias("a"), n.alias("n"))),
        lambda x: F.struct((x["a"] - 1).alias("start"), (x["a"] + x["n"] - 2).alias("end")),
    )


def preview(c: Column, start: Column, end: Column, context: int = CONTEXT) -> Column:
    """The text about a hit, ``context`` signs on either side, blanks drawn together, with an ellipsis where it is cut."""
    lo, hi = F.greatest(start - context, F.lit(0)), F.least(end + context + 1, F.char_length(c))
    clean = F.regexp_replace(F.regexp_replace(F.substr(c, lo + 1, hi - lo), r"[\x{0}\x{AD}]", ""), rf"{_BLANKS}+", " ")
    return F.concat(F.when(lo > 0, "…").otherwise(""), F.trim(clean), F.when(hi < F.char_length(c), "…").otherwise(""))


def _starts_by(parts: Column, steps: Column) -> Column:
    """Where (from 1) each step begins, if parts and steps take turns."""
    n = F.size(steps)
    before = F.slice(F.concat(F.array(F.lit(0)), steps), 1, n)  # the step that went before each part
    lengths = F.zip_with(F.transform(F.slice(parts, 1, n), lambda p: F.char_length(p)), before, lambda p, s: p + s)
    return F.transform(_running(lengths), lambda x: x + 1)


def _running(x: Column) -> Column:
    """Running sums of an array of ints, block by block, so that long arrays aren't copied for every element."""
    block = 512
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(block)), lambda b: F.slice(x, b + 1, block))
    none = F.array().cast("array<int>")
    add = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out"))
    sums = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), add, lambda a: a["out"])
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(blocks, start, lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.concat(a["out"], F.array(sums(b, a["at"]))).alias("out")), lambda a: F.flatten(a["out"]))


def _starts(parts: Column, step: int) -> Column:
    """1 and the lengths of the parts before, with ``step`` for each, of all parts but the last."""
    lengths = F.transform(parts, lambda p: F.char_length(p))
    block = 512
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(block)), lambda b: F.slice(lengths, b + 1, block))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n + step)
    ends = F.aggregate(
        blocks,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<array<int>>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["out"], F.array(_within(b, acc["at"], step))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.slice(ends, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _within(lengths: Column, at: Column, step: int) -> Column:
    start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(lengths, start, lambda a, n: F.struct((a["at"] + n + step).alias("at"), F.concat(a["found"], F.array(a["at"] + n)).alias("found")), lambda a: a["found"])
