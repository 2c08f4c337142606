"""License scan by ordered signature rules, in DataFrame and SQL functions only.

Rules are regular expressions on the lower-cased words of a text, joined by single blanks.  A
rule is tried only where its keyword occurs, and none is tried on a text without any of a few
stems that all rules need.  Of two detections of which one contains the other, the one with the
higher priority stays, then the longer, then the earlier rule.
"""

from pyspark.sql import functions as F

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases of the base scan and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Label, keyword that every alternative of the name holds, words of the name (a
# regular expression), SPDX words.
FAMILIES = (
    ("apache-1.1", "apache", "apache (?:software )?license(?: version)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache (?:software )?license", "apache"),
    ("mit", "mit", "mit license", "mit"),
    ("mit-0", "mit", "mit no attribution(?: license)?", "mit 0"),
    ("x11", "x11", "x11 license", "x11"),
    ("bsd", "bsd", "bsd(?: style)? license", "bsd"),
    ("bsd-0-clause", "bsd", "(?:zero|0) clause bsd(?: license)?", "0bsd"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|(?:two|2) clause) bsd(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|(?:three|3) clause) bsd(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|(?:four|4) clause) bsd(?: license)?", "bsd 4 clause"),
    ("isc", "isc", "isc license", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("gpl-2.0", "general", "gnu general public license(?: v| version)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general", "gnu general public license(?: v| version)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general", "gnu general public license", "gpl"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: v| version)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license(?: v| version)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "general", "gnu (?:lesser|library) general public license", "lgpl"),
    ("agpl-3.0", "affero", "gnu affero general public license(?: v| version)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public license", "agpl"),
    ("gfdl", "documentation", "gnu free documentation license(?: version 1 [123])?", "gfdl 1 [123]"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: v| version)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: v| version)? 2 0", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public license", "mpl"),
    ("epl-1.0", "eclipse", "eclipse public license(?: v| version)? 1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: v| version)? 2 0", "epl 2 0"),
    ("cddl-1.0", "distribution", "common development and distribution license(?: version)?(?: 1 0)?", "cddl 1 0"),
    ("cpl-1.0", "common", "common public license(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: v| version)?(?: 1 2)?", "eupl 1 2"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic license", "artistic 1 0"),
    ("cc-by-4.0", "4 0", "cc by 4 0|creative commons attribution 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-3.0", "3 0", "cc by 3 0|creative commons attribution 3 0(?: unported)?", "cc by 3 0"),
    ("cc-by-sa-4.0", "sa", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa", "sa", "cc by sa", "cc by sa 3 0"),
    ("cc-by-nc-4.0", "nc", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc", "nc", "cc by nc", "cc by nc 3 0"),
    ("cc-by-nd-4.0", "nd", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nd", "nd", "cc by nd", "cc by nd 3 0"),
    ("cc-by-nc-sa-4.0", "nc", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-sa", "nc", "cc by nc sa", "cc by nc sa 3 0"),
    ("cc-by-nc-nd-4.0", "nc", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-nd", "nc", "cc by nc nd", "cc by nc nd 3 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-attribution", "commons", "creative commons attribution(?: license)?", "cc by 2 0"),
    ("cc-sharealike", "commons", "creative commons attribution share ?alike(?: [34] 0)?", "cc by sa 2 0"),
    ("cc-noncommercial", "commons", "creative commons attribution non ?commercial(?: [34] 0)?", "cc by nc 2 0"),
    ("odbl-1.0", "database", "open (?:data commons open )?database license(?: v1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", "open data commons attribution license(?: v1 0)?", "odc by 1 0"),
    ("pddl-1.0", "domain", "public domain dedication and license(?: v1 0)?", "pddl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "want", "do what the f[a-z]+ you want to public license", "wtfpl"),
    ("bsl-1.0", "boost", "boost software license(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("psf-2.0", "python", "python software foundation license(?: version 2)?", "psf 2 0"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("sspl-1.0", "server", "server side public license(?: v1)?", "sspl 1 0"),
    ("busl-1.1", "business", "business source license(?: 1 1)?", "busl 1 1"),
    ("openrail", "license", "responsible ai license|openrail(?: m)? license", "openrail"),
    ("osl-3.0", "open", "open software license(?: v| version)?(?: 3 0)?", "osl 3 0"),
    ("afl-3.0", "academic", "academic free license(?: v| version)?(?: 3 0)?", "afl 3 0"),
    ("ncsa", "illinois", "university of illinois ncsa open source license", "ncsa"),
    ("vim", "vim", "vim license", "vim"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
)
# How a family is mentioned: suffix, expression, keyword of its own, priority, confidence.
MENTIONS = (
    ("spdx", "spdx license identifier (?:{spdx})", "spdx", 40, 0.99),
    (
        "notice",
        "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|shared)"
        " under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})",
        "under",
        30,
        0.95,
    ),
    (
        "grant",
        "(?:use|copy|redistribute|modify|reuse|licen[cs]e)(?: is)?(?: it| this [a-z]+)?"
        " (?:under|subject to|according to) (?:the )?(?:terms of (?:the )?)?(?:{name})",
        None,
        28,
        0.9,
    ),
    ("reference", "(?:see|read|consult|accept|copy of) (?:the )?(?:{name})", None, 20, 0.7),
    ("name", "(?:{name})", None, 10, 0.6),
)
# Label, keyword, expression, priority, confidence of rules without a family.
OTHERS = (
    ("all-rights-reserved", "reserved", "all rights reserved", 35, 0.8),
    ("some-rights-reserved", "reserved", "some rights reserved", 35, 0.7),
    ("no-rights-reserved", "reserved", "no rights reserved", 35, 0.8),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 15, 0.6),
    ("copyright", "copyright", "copyright (?:c )?by [^ ]+", 14, 0.5),
    ("copyright", "copyright", "(?:c )?copyright (?:holder|owner|notice)s?", 12, 0.4),
    ("public-domain", "domain", "(?:in|into|to|dedicated to) the public domain", 25, 0.8),
    ("public-domain", "domain", "public domain", 8, 0.5),
    ("warranty-disclaimer", "warranty", "without warranty of any kind", 18, 0.6),
    ("warranty-disclaimer", "warranties", "without (?:express or implied )?warranties", 18, 0.6),
    ("warranty-disclaimer", "warranty", "absolutely no warranty", 18, 0.6),
    ("permissive-grant", "permission", "permission is hereby granted free of charge", 33, 0.9),
    ("permissive-grant", "permission", "permission to use copy modify and(?: or)? distribute", 33, 0.9),
    ("copyleft", "copyleft", "copyleft", 9, 0.4),
    ("proprietary", "proprietary", "(?:confidential and )?proprietary (?:license|licence|software)", 22, 0.6),
    ("proprietary", "permission", "without (?:the )?(?:prior )?written permission", 22, 0.6),
)
# Stems one of which every rule and every phrase needs.
STEMS = ("licen", "reserved", "copyright", "public domain", "warrant", "permission", "copyleft",
         "cc by", "cc0", "creative commons", "mit no", "clause bsd", "bsd", "proprietary")
_SPAN = "array<struct<s:int,n:int>>"


def rules():
    """``(number, label, keyword, expression, priority, confidence)`` of all rules in order."""
    found = []
    for label, keyword, name, spdx in FAMILIES:
        for _, shape, own, priority, confidence in MENTIONS:
            found.append(
                (label, own or keyword, shape.format(name=name, spdx=spdx), priority, confidence)
            )
    found += [(label, keyword, shape, p, c) for label, keyword, shape, p, c in OTHERS]
    return [
        (i, label, keyword, f"(?<= )(?:{shape})(?= )", priority, confidence)
        for i, (label, keyword, shape, priority, confidence) in enumerate(found)
    ]


def _let(name, value, body):
    """``value`` worked out once under ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blanks(text):
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def _places(words, shape):
    """SQL: the spans ``(s, n)``, first word and number of words, where ``shape`` matches."""
    step = f"""named_struct(
        'at', p.at + {_blanks('g')} + {_blanks('h')},
        'out', array_append(p.out, named_struct('s', p.at + {_blanks('g')} - 1, 'n', {_blanks('h')} + 1)))"""
    step = _let("g", "get(gaps, i)", _let("h", "get(hits, i)", step))
    walk = f"""aggregate(sequence(0, size(hits) - 1),
        named_struct('at', 0, 'out', cast(array() as {_SPAN})),
        (p, i) -> {step}, p -> p.out)"""
    found = _let("gaps", f"split({words}, {shape})", f"if(size(hits) = 0, cast(array() as {_SPAN}), {walk})")
    return _let("hits", f"regexp_extract_all({words}, {shape}, 0)", found)


def _quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs):
    """``doc_id, n_words, base, detections`` for each row of ``docs``.

    ``base`` are the spans ``(label, s, n)`` of the fixed phrases, all places.  ``detections``
    are those ``(s, n, rule, label, priority, confidence)`` that containment leaves.
    """
    # Lower-casing letters beyond A-Z too moves no word border and makes none of the phrases.
    words = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), WORD_GAP, " ")
    read = docs.select("doc_id", F.concat(F.lit(" "), F.trim(words), F.lit(" ")).alias("words"))
    maybe = F.lit(False)
    for stem in STEMS:
        maybe = maybe | F.contains("words", F.lit(stem))
    read = read.withColumn("maybe", maybe)
    base = [
        f"if(contains(words, {_quoted(f' {phrase} ')}), transform("
        f"{_places('words', _quoted(f'(?<= ){phrase}(?= )'))}, "
        f"x -> named_struct('label', {_quoted(label)}, 's', x.s, 'n', x.n)), "
        "cast(array() as array<struct<label:string,s:int,n:int>>))"
        for phrase, label in BASE
    ]
    table = ", ".join(
        f"named_struct('i', {i}, 'label', {_quoted(label)}, 'key', {_quoted(key)},"
        f" 'shape', {_quoted(shape)}, 'priority', {priority}, 'confidence', {confidence}D)"
        for i, label, key, shape, priority, confidence in rules()
    )
    matched = f"""flatten(transform(filter(array({table}), r -> contains(words, r.key)),
        r -> transform({_places('words', 'r.shape')}, x -> named_struct('s', x.s, 'n', x.n,
            'rule', r.i, 'label', r.label, 'priority', r.priority, 'confidence', r.confidence))))"""
    nested = (
        "(y.s <= x.s and y.s + y.n >= x.s + x.n or x.s <= y.s and x.s + x.n >= y.s + y.n)"
    )
    better = (
        "named_struct('p', y.priority, 'n', y.n, 'r', -y.rule)"
        " > named_struct('p', x.priority, 'n', x.n, 'r', -x.rule)"
    )
    left = _let("all", matched, f"filter(all, x -> not exists(all, y -> {nested} and {better}))")
    none = "array<struct<s:int,n:int,rule:int,label:string,priority:int,confidence:double>>"
    return read.select(
        "doc_id",
        F.when(F.col("words") == "  ", 0).otherwise(F.expr(_blanks("words")) - 1).cast("long").alias("n_words"),
        F.when(F.col("maybe"), F.expr(f"concat({', '.join(base)})")).alias("base"),
        F.when(F.col("maybe"), F.expr(f"cast({left} as {none})")).alias("detections"),
    )


def query(docs):
    """One row per row of ``docs``: words, base places, labels and a score.

    The score is the largest confidence among the detections, 0 without any.  Null and empty
    texts have no words and no labels.
    """
    starts = F.transform("base", lambda b: b["s"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    found = F.transform("detections", lambda d: d["label"])
    empty = F.array().cast("array<string>")
    joined = F.array_union(F.coalesce(base, empty), F.coalesce(found, empty))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.greatest(F.coalesce(F.size("base"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.coalesce(base, empty)), ",").alias("base_labels"),
        F.array_join(F.sort_array(joined), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
