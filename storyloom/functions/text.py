"""Normal forms, hashes and extraction from text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words of entity extraction, by kind.
AGENCY_WORDS = """
fda hhs epa cdc nih usda doj dhs dod doe dot va ssa irs gsa nasa noaa fema cms
department departments administration agency agencies office offices bureau
bureaus commission federal national united states secretary center centers
institute institutes service services treasury
""".split()
BOILERPLATE_WORDS = """
announces announcement announced statement statements recall recalls notice
notices press release releases update updated updates news alert alerts issues
issued proposes proposed final rule rules regulation regulations report reports
officials designate designates designated launches launched celebrates
celebrating meets meeting knows opens closes remarks readout briefing
chronology photo photos video videos podcast blog webinar factsheet
january february march april may june july august september october
november december monday tuesday wednesday thursday friday saturday sunday
today yesterday tomorrow week weekly month monthly year yearly annual daily
quarterly fiscal nationwide public
""".split()
#: Hard event keys (vulnerabilities, dockets, register documents, recalls, court cases).
EVENT_KEYS = (
    r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    r"\b[A-Z]{2,6}(?:-[A-Z]{1,6})*-\d{4}-\d{3,5}(?:-\d{1,6})?\b",
    r"\b(?<!-)\d{4}-\d{5,6}\b",
    r"\b[ZF]-\d{4}-\d{2,4}\b",
    r"(?i)\b(?:case|docket)\s+no\.\s?\d{2}-\d{2,5}\b",
)


def folded(text: Column) -> Column:
    """Lower case with the foldings that lower() leaves: sharp s as ss, final sigma as sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def nfkc(text: Column) -> Column:
    """Unicode's NFKC form, which Spark SQL has no function for: for texts with compatibility characters."""

    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(normal, StringType())(text)


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends, case folded. Null becomes empty."""
    return folded(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def content_hash(title: Column, summary: Column) -> Column:
    """sha256 of the normal forms of title and summary, by a line end."""
    return F.sha2(F.concat(squeeze(title), F.lit("\n"), squeeze(summary)), 256)


def candidate_key(external_id: Column, url: Column) -> Column:
    """sha256 of an outside id and a URL."""
    return F.sha2(F.concat(F.coalesce(external_id, F.lit("")), F.lit("\n"), F.coalesce(url, F.lit(""))), 256)


def receipt(version: str, fields: dict[str, Column]) -> Column:
    """A versioned sha256 over fields in canonical form: JSON with sorted names, nulls written, no white space."""
    sorted_fields = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.concat(F.lit(f"{version}:"), F.sha2(F.to_json(sorted_fields, {"ignoreNullFields": "false"}), 256))


#: Characters after which a sentence end is no sign of prose any more.
HORIZON = 240
#: Characters of a body that are read.
BODY_CAP = 4000
# Fixed value: a city in capitals, maybe a state, and a dash with spaces, as wire stories begin.
DATELINE = r"\b([A-Z][A-Z'.-]+(?:\s+[A-Z][A-Z'.-]+)*)(?:,\s*[A-Z][A-Za-z]{0,5}\.?)?\s+[–—-]\s+"


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end within the horizon; else empty, as the text doesn't read like prose."""
    at = F.regexp_instr(text, F.lit(r"[.!?](?:\s|$)"))
    return F.when(at.between(1, HORIZON + 1), F.substr(text, F.lit(1), at)).otherwise("")


def prose(text: Column) -> tuple[Column, Column]:
    """The first prose sentence of a text, after a dateline at its head, and the dateline's city (both may be empty)."""
    text = F.coalesce(text, F.lit(""))
    head = F.substring(text, 1, HORIZON)
    line = F.regexp_extract(head, DATELINE, 0)
    after = F.when(line == "", text).otherwise(F.substr(text, F.regexp_instr(head, F.lit(DATELINE)) + F.length(line)))
    return first_sentence(after), F.regexp_extract(head, DATELINE, 1)


def entities(
    title: Column, summary: Column, body: Column | None = None, *, stop: tuple[str, ...] = (), most: int = 64
) -> Column:
    """Distinct words of capitalised spans and dollar amounts, folded, in the title and the first prose sentence,
    and the words of a dateline's city; sorted, at most `most`. A summary without prose gives way to the head of the
    body. Words under four letters, of agencies and of boilerplate are left out, as are those in stop."""
    sentence, city = prose(summary)
    if body is not None:
        other_sentence, other_city = prose(F.substring(body, 1, BODY_CAP))
        bare = (sentence == "") & (city == "")
        sentence, city = F.when(bare, other_sentence).otherwise(sentence), F.when(bare, other_city).otherwise(city)
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), sentence)
    amounts = F.regexp_extract_all(text, F.lit(r"((?i)\$\d[\d,.]*(?:\s?(?:million|billion|trillion))?)"), F.lit(1))
    spans = F.regexp_extract_all(text, F.lit(r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b)"), F.lit(1))
    words = F.flatten(F.transform(F.concat(spans, F.array(city)), lambda s: F.split(s, r"\s+")))
    bare_words = F.transform(words, lambda w: folded(F.regexp_replace(w, r"^[.,;:'\"()]+|[.,;:'\"()]+$", "")))
    stops = F.array(*map(F.lit, [*AGENCY_WORDS, *BOILERPLATE_WORDS, *stop]))
    named = F.filter(bare_words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stops, w))
    money = F.transform(amounts, lambda a: squeeze(a))
    return F.slice(F.array_sort(F.array_distinct(F.concat(money, named))), 1, most)


def keys_text(title: Column, summary: Column, body: Column) -> Column:
    """What event keys are read from: the title and the summary, or the head of the body where there is no summary."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(F.nullif(summary, F.lit("")), F.substring(body, 1, BODY_CAP), F.lit("")))


def event_keys(text: Column, most: int | None = None) -> Column:
    """Distinct hard event keys, sorted; all of them, or the first `most`."""
    found = [F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in EVENT_KEYS]
    keys = F.array_sort(F.array_distinct(F.transform(F.concat(*found), lambda k: squeeze(k))))
    return keys if most is None else F.slice(keys, 1, most)


def is_valid_enrichment(text: Column, markers: tuple[str, ...], least_chars: int = 40, least_alnum: int = 20) -> Column:
    """Long enough, with enough letters and digits, and without marks of boilerplate."""
    t = F.coalesce(text, F.lit(""))
    bare = F.length(F.regexp_replace(t, "[^A-Za-z0-9]", ""))
    clean = [~F.contains(F.lower(t), F.lit(m)) for m in markers]
    out = (F.length(F.trim(t)) >= least_chars) & (bare >= least_alnum)
    for c in clean:
        out = out & c
    return out


def title_tokens(title: Column, least: int = 4) -> Column:
    """Distinct words of letters and digits of a title in lower case, of a least length, sorted."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda w: F.length(w) >= least)))


def is_theme_name(name: Column) -> Column:
    """Two to five words, each of letters and digits."""
    words = F.split(F.trim(name), r"\s+")
    return F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike("^[A-Za-z0-9]+$"))


def strip_markup(html: Column) -> Column:
    """Tags to spaces, the five basic character references read, white space squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def big_mod(sha256_hex: Column, n: int) -> Column:
    """A sha256 as a whole number modulo n < 2^31, from its eight 32-bit parts."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(sha256_hex, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: (acc * (1 << 32) % n + p) % n)


#: Weights of a phrase in the title (several words, one word) and in the content alone, of an override, and
#: the least score and margin of each confidence.
IN_TITLE, IN_CONTENT, OVERRIDE = (5.0, 3.5), (1.4, 0.8), 11.0
CONFIDENCE = {"high": (9, 4), "medium": (6, 2)}


def lexical_category(
    title: Column, content: Column, publisher: Column, *, phrases: dict[str, tuple[str, ...]],
    priors: dict[str, dict[str, float]] | None = None, overrides: dict[str, tuple[str, ...]] | None = None,
) -> Column:
    """Struct (category, margin, confidence) of the category that scores best by its phrases: 5 for one of several
    words in the title and 3.5 for a single word, 1.4 and 0.8 where only the content has it; a publisher's prior is added,
    and 11 where the title has an override phrase. Of equal scores the first name. The rules are parameters of bounded
    size, so the score is an expression over one row: no join, no shuffle."""
    t, c = folded(title), folded(content)
    scores = []
    for name in sorted(phrases):
        score = F.lit(0.0)
        for p in phrases[name]:
            several = " " in p
            score = score + F.when(F.contains(t, F.lit(p)), IN_TITLE[not several]).when(F.contains(c, F.lit(p)), IN_CONTENT[not several]).otherwise(0.0)
        for source, given in (priors or {}).items():
            if name in given:
                score = score + F.when(publisher == source, given[name]).otherwise(0.0)
        decisive = F.lit(False)
        for p in (overrides or {}).get(name, ()):
            decisive = decisive | F.contains(t, F.lit(p))
        scores.append(F.struct((-F.round(score + F.when(decisive, OVERRIDE).otherwise(0.0), 6)).alias("s"), F.lit(name).alias("category")))
    best = F.array_sort(F.array(*scores))
    top, margin = -F.get(best, F.lit(0))["s"], F.round(F.get(best, F.lit(1))["s"] - F.get(best, F.lit(0))["s"], 6)
    reached = {name: (top >= score) & (margin >= ahead) for name, (score, ahead) in CONFIDENCE.items()}
    confidence = F.when(reached["high"], "high").when(reached["medium"], "medium").otherwise("low")
    return F.struct(F.get(best, F.lit(0))["category"].alias("category"), margin.alias("margin"), confidence.alias("confidence"))
