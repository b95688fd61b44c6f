"""Personal data: rule spans, and boosted trees over wider candidate spans. DataFrame and Spark ML operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import broadcast_within, materialize, text_hash

#: What the rules find, and what only the trees do.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# The rules' patterns in a form whose matching takes time in proportion to the text: a match may only begin where a run of its
# first characters begins or where the last match ended, since a run that fails from its first character fails from all.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\.(?={_LABEL})(?:(?!\.(?!{_LABEL}))[A-Za-z0-9.-])*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What keys begin with that well-known services issue.
ISSUED = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|hf_|rk_live_|sk_live_|sk_test_|xoxb-|xoxp-)[A-Za-z0-9+/_-]{12}"
#: High-recall generators: kind, pattern.
CANDIDATES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++ ?(?:@|\(at\)|\[at\]|\{{at\}}) ?{_LABEL}++(?: ?(?:\.|\(dot\)|\[dot\]) ?{_LABEL}++){{1,8}}",
    "ip": r"(?:(?<![0-9.:])|\G)[0-9]{1,5}+(?:(?:[.:]|[\[\(]\.[\]\)]| ?[\[\(]dot[\]\)] ?)[0-9]{1,5}+){3,7}+",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:(?![ ./-](?![0-9]))[0-9 ./-]){10,30}",
    "phone": r"(?:(?<![0-9+])|\G)(?:\+|00)?\(?[0-9](?:(?![ ./()-]{3})[0-9 ./()-]){6,22}[0-9]",
    "secret": rf"(?<![A-Za-z0-9+/_-])(?:(?={ISSUED[1:]})|(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]))[A-Za-z0-9+/_-]{{16,}}+",
}
CONTEXT_CHARS = 24
#: The trees are fitted on all labelled candidates; those of a kind and label together weigh as much as so many rows at most, so that no kind drowns another.
SIDE_WEIGHT = 2_000
#: Different rows (by features) that are fitted in one fixed order; more are fitted as they lie, and sums of doubles may differ in their last bits.
ORDERED_ROWS = 50_000
#: Spans whose forms one task makes.
TASK_ORIGINS = 1_000
#: The precision that a kind's threshold keeps on held-out rows, and the least threshold.
PRECISION, EVEN = 0.98, 0.5


def _matches(text: Column, pattern: str, needed: str) -> Column:
    """Non-overlapping matches from the left as (m, gap, before, after): the text between matches gives positions and context."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before")))
    after = F.transform(F.slice(gaps, 2, F.size(found)), lambda g: F.left(g, F.lit(1)))
    both = F.zip_with(zipped, after, lambda z, a: F.struct(z["m"].alias("m"), z["gap"].alias("gap"), z["before"].alias("before"), a.alias("after")))
    empty = F.array().cast("array<struct<m:string,gap:int,before:string,after:string>>")
    return F.when(text.rlike(needed), both).otherwise(empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: Column, m: Column) -> Column:
    """The rules' second half: ranges of an address, length and check digit of a card, length of a phone number."""
    d = digits(m)
    parts = F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts)
        .when(kind == "card", F.length(d).between(13, 19) & F.call_function("luhn_check", d))
        .otherwise(F.length(d).between(9, 15))
    )


def plausible(kind: Column, m: Column) -> Column:
    """Whether a wide candidate can be what its kind says, its obfuscation undone: an address with a name for its last label, four parts, a card's
    digits, a phone's. Only such candidates are put to the trees, which don't see this test."""
    plain = F.regexp_replace(F.regexp_replace(m, r" ?[\(\[\{]at[\)\]\}] ?", "@"), r" ?[\(\[](?:dot|\.)[\)\]] ?", ".")
    email = plain.rlike(rf"^{_LOCAL}+@(?:{_LABEL}+\.)+[A-Za-z][A-Za-z0-9-]*[A-Za-z]$")
    secret = ((F.length(digits(m)) >= 4) | m.rlike(ISSUED)) & ~m.rlike("[a-z]{10}|[A-Z][a-z]{5}")  # no run of a word
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", (plain != m) & plain.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & valid(kind, plain)).otherwise(valid(kind, m))


def origins(found: DataFrame) -> DataFrame:
    """(kind, m, before, after, ok): every different span of each kind that the rules found, and every match that failed their second half."""
    each = found.where("base").groupBy("kind", "m", "ok").agg(F.min(F.struct("before", "after")).alias("c")).select("kind", "m", "ok", "c.*")
    each = materialize(each, "pii-origins")
    return each.repartition(max(1, each.count() // TASK_ORIGINS))  # an origin's row is small but its forms are not


def repaired(failed: DataFrame) -> DataFrame:
    """Negative rows (kind, m, before, after, origin, label) that look right: failed card numbers with their check digit put right, and plain runs of
    digits laid out as phone numbers, where the corpus has them. What tells them from the positives is where they stand, not a rule. One in nine
    failed numbers is taken: for nine that fail the check, chance lets one pass."""
    d = digits(F.col("m"))
    body = F.expr("left(d, length(d) - 1)")
    # the check digit makes the Luhn sum a multiple of ten: try all ten
    right = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string"))), lambda x: F.call_function("luhn_check", x))
    card = F.get(right, F.lit(0))
    fours = lambda by: F.regexp_replace(card, "([0-9]{4})(?=[0-9])", f"$1{by}")
    lay = lambda by: F.concat(F.substring(F.col("d"), 1, 3), F.lit(by), F.substring(F.col("d"), 4, 3), F.lit(by), F.substring(F.col("d"), 7, 4))
    rows = failed.where("not ok").withColumn("d", d)
    rows = rows.where(F.pmod(F.xxhash64(F.lit("repaired"), "m"), F.lit(9)) == 0)
    long = rows.where((F.col("kind") == "card") & F.length("d").between(13, 19))
    cards = long.select("before", "after", F.col("m").alias("origin"), F.explode(F.array(fours("."), fours("/"))).alias("m"), F.lit("card").alias("kind"))
    phones = rows.where((F.col("kind") == "card") & (F.length("d") >= 10)).select("before", "after", F.col("m").alias("origin"), F.explode(F.array(*[lay(x) for x in "-./ "])).alias("m"), F.lit("phone").alias("kind"))
    return cards.unionByName(phones).where("m is not null").select("kind", "m", "before", "after", "origin", F.lit(0.0).alias("label"))


def rewritten(spans: DataFrame) -> DataFrame:
    """Training rows from validated rule spans, in forms that the rules miss: (kind, m, before, after, origin, label).

    Positive: addresses with (at) and (dot), cards with other separators, phone numbers without '+' or country code, and keys made
    of the span's hash, each after several words for credentials, or after any word if they begin as issued keys do. Negative: plain numbers built from the same
    digits (prices, dates, amounts, cards with a wrong check digit), and digests, time stamps, capital codes and numbered names after other words.
    Only forms that the wide generators propose stay.
    """
    m, d = F.col("m"), digits(F.col("m"))
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    national = F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]+(?=[(0-9])", "")
    fours = F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1-")
    wrong = F.concat(F.expr("left(m, length(m) - 1)"), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    long = F.rpad(d, 12, "7")
    date = F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), F.substring(d, 3, 1), F.lit("-1"), F.substring(d, 4, 1))

    def separated(c: Column, by: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"[()]", ""), r"[ .-]+", by)

    price = F.concat(F.length(m).cast("string"), F.lit(" @ "), F.length(domain).cast("string"), F.lit("."), F.lpad(F.length(local).cast("string"), 2, "0"))
    forms = {
        ("email", 1.0): [F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot))) for at, dot in ((" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", "."), ("{at}", "."), ("@", "(dot)"))],
        ("email", 0.0): [price, F.concat(local, F.lit(" @ "), F.length(m).cast("string"), F.lit(".5")), F.concat(local, F.lit(" @ "), F.substring_index(domain, ".", 1), F.lit(". "), F.substring_index(domain, ".", -1))],
        ("ip", 1.0): [*[F.replace(m, F.lit("."), F.lit(x)) for x in ("[.]", "(.)", "[dot]", " [dot] ", " (dot) ")], F.concat(F.substring_index(m, ".", 3), F.lit("[.]"), F.substring_index(m, ".", -1))],
        ("ip", 0.0): [F.replace(m, F.lit("."), F.lit(":")), F.concat(m, F.lit(".7")), F.concat(F.lit("1"), F.replace(m, F.lit("."), F.lit(".3"))), F.concat(F.replace(m, F.lit("."), F.lit("[.]")), F.lit("[.]0")), F.concat(F.lit("3"), F.replace(m, F.lit("."), F.lit("(dot)4")))],
        ("card", 1.0): [F.replace(fours, F.lit("-"), F.lit(x)) for x in "./"],
        ("card", 0.0): [F.regexp_replace(F.regexp_replace(wrong, "[^0-9]", ""), "([0-9]{4})(?=[0-9])", f"$1{x}") for x in "./"] + [F.substring(d, 1, 11)],
        ("phone", 1.0): [F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+", "00"), national, *[separated(national, x) for x in "-./ "], F.concat(F.lit("0"), separated(national, " ")), F.concat(F.lit("0"), separated(national, "/"))],
        ("phone", 0.0): [d, long, date, F.concat(date, F.lit(" "), F.substring(long, 5, 4)), F.regexp_replace(F.substring(long, 1, 12), "([0-9]{3})(?=[0-9])", "$1."), F.regexp_replace(F.substring(long, 1, 10), "([0-9])(?=(?:[0-9]{3})+$)", "$1."), F.concat(F.substring(long, 1, 8), F.lit("."), F.substring(long, 9, 2))],
    }

    def row(kind: str, form: Column, label: float, before: Column, after: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), form.alias("m"), before.alias("before"), after.alias("after"), F.lit(label).alias("label"))

    made = [F.when(F.col("kind") == kind, row(kind, form, label, F.col("before"), F.col("after"))) for (kind, label), group in forms.items() for form in group]
    sha, b64 = F.sha2(m, 256), F.replace(F.base64(F.unhex(F.sha2(F.concat(m, F.lit("/")), 256))), F.lit("="), F.lit(""))
    keys = [F.substring(sha, 1, 32), F.substring(sha, 1, 40), sha, F.substring(b64, 1, 22), b64, F.concat(F.lit("AKIA"), F.upper(F.substring(sha, 5, 16))), F.concat(F.lit("sk_live_"), F.substring(b64, 9, 24))]
    given = ['token = "', "api_key=", "password: ", "bearer ", "secret: '", 'the key is "', "auth="]
    stamp = F.concat(F.lit("2023-10-1"), F.substring(d, 1, 1), F.lit("T0"), F.substring(d, 2, 1), F.lit("-"), F.substring(d, 3, 2), F.lit("-00Z"))
    short = [F.substring(sha, 5, 16), F.substring(sha, 9, 20), F.substring(sha, 7, 24)]
    plain = [(x, b) for x in keys[:5] + short for b in ("commit ", "checksum: ", "md5 = ", "file ", "of the ")]
    plain += [(stamp, "on "), (F.concat(F.lit("section-"), F.substring(d, 1, 3), F.lit("-part-"), F.substring(d, 3, 4)), "see "), (F.concat(F.lit("img_"), F.rpad(d, 14, "0")), "file ")]
    caps = F.upper(F.translate(b64, "+/", "qz"))
    issued = [F.concat(F.lit("AKIA"), F.substring(caps, 3, 16)), F.concat(F.lit("ASIA"), F.substring(caps, 20, 16)), F.concat(F.lit("ghp_"), F.substring(F.translate(b64, "+/", "qz"), 5, 36)), F.concat(F.lit("AIza"), F.substring(b64, 7, 35)), F.concat(F.lit("xoxb-"), F.rpad(d, 12, "3"), F.lit("-"), F.substring(b64, 9, 24))]
    plain += [(F.substring(caps, 3, n), b) for n in (16, 20, 24) for b in ("part ", "of the ")] + [(F.concat(F.lit("sk_test_case_"), F.substring(d, 1, 8)), "see ")]
    named = [("data_table_", 4, "_backup"), ("report_", 4, "_final_copy"), ("release-notes-v", 3, "-draft"), ("user_names_", 6, "")]
    plain += [(F.concat(F.lit(x), F.substring(long, 1, n), F.lit(y)), b) for x, n, y in named for b in ("of the ", "see ")]
    made += [row("secret", x, 1.0, F.lit(b), F.lit(" ")) for x in issued for b in ("of the ", "and ")]
    made += [row("secret", x, 1.0, F.lit(b), F.lit('"')) for i, x in enumerate(keys + short) for b in (given[i % 7], given[(i + 2) % 7], given[(i + 4) % 7])] + [row("secret", x, 0.0, F.lit(b), F.lit(" ")) for x, b in plain]
    rows = spans.where("ok").select(m.alias("origin"), F.explode(F.filter(F.array(*made), lambda x: x["m"].isNotNull())).alias("x")).select("origin", "x.*")
    proposed = reduce(lambda a, k: a | ((F.col("kind") == k) & m.rlike(rf"^(?:{CANDIDATES[k]})$")), ALL_KINDS, F.lit(False))
    apart = m.rlike("[^0-9]|^00")  # a positive isn't a plain run
    return rows.where(proposed & ((F.col("label") == 0) | (apart & plausible(F.col("kind"), m))))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, th, kind, base, start, end, m, before, after, ok): matches of the rules (base) and of the wider generators.

    Positions are in code points: running sums of the lengths of gaps and matches, over one document's matches of a pattern.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    needed = {"email": r"@|[\(\[\{]at[\)\]\}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": f"[0-9]|{ISSUED[1:]}"}

    def tagged(kind: str, base: bool, pattern: str) -> Column:
        found = _matches(t, pattern, "@" if base and kind == "email" else needed[kind])
        return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), x.alias("x")))

    packed = F.concat(*[tagged(k, b, p) for b, group in ((True, BASE), (False, CANDIDATES)) for k, p in group.items()])
    rows = docs.select("doc_id", text_hash(F.col(text)).alias("th"), F.explode(packed).alias("c")).select("doc_id", "th", "c.kind", "c.base", "c.i", "c.x.*").dropDuplicates(["doc_id", "th", "kind", "base", "i"])
    upto = Window.partitionBy("doc_id", "th", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).withColumn("ok", valid(F.col("kind"), F.col("m"))).drop("gap", "i")


def _word() -> Column:
    """The last word before a candidate, in small letters; empty without one."""
    return F.regexp_extract(F.lower("before"), r"(\p{L}{2,})[^\p{L}]*$", 1)


def weighed(sums: DataFrame) -> DataFrame:
    """Summed labelled rows (n of them alike) with their weight w: a kind's rows of a label together weigh SIDE_WEIGHT at most, each of them alike."""
    side = sums.groupBy("kind", "label").agg(F.sum("n").alias("side"))  # two rows a kind
    return sums.join(F.broadcast(side), ["kind", "label"]).withColumn("w", F.col("n") * F.least(F.lit(1.0), F.lit(float(SIDE_WEIGHT)) / F.col("side"))).drop("side")


def word_odds(sums: DataFrame) -> DataFrame:
    """(wk, ww, odds): how much more a word's rows before positives of a kind weigh than those before negatives."""
    n, hits = F.sum("w"), F.sum(F.col("w") * F.col("label"))
    odds = F.log((hits + 1) / (n - hits + 1))
    return sums.groupBy(F.col("kind").alias("wk"), F.col("word").alias("ww")).agg(F.round(odds, 2).alias("odds"), F.sum("n").alias("n")).where("n >= 3").drop("n")


def _with_odds(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with the odds of the word before them as a feature; 0 for words that no labelled row has."""
    return rows.join(words, (F.col("kind") == F.col("wk")) & (F.col("word") == F.col("ww")), "left").withColumn("f_word", F.coalesce("odds", F.lit(0.0))).drop("wk", "ww", "word", "odds")


def _features(c: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rows with the word before them and all features but that word's odds, these features)."""
    m, before = F.col("m"), F.lower("before")
    d = digits(m)
    coarse = lambda v: F.when(F.col("kind") == "secret", F.floor(v / 4) * 4).otherwise(v)  # noqa: E731 - of random characters the exact counts say nothing, and rows alike are summed
    cols = {
        "f_len": F.length(m), "f_digits": coarse(F.length(d)), "f_groups": coarse(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))), "f_letters": coarse(F.length(F.regexp_replace(m, "[^A-Za-z]", ""))),
        "f_plus": m.startswith("+").cast("int"), "f_paren": m.contains("(").cast("int"), "f_dots": F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))),
        "f_dash": F.length(m) - F.length(F.replace(m, F.lit("-"), F.lit(""))), "f_space": F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))),
        "f_at": m.contains("@").cast("int"), "f_first": F.when(F.col("kind") == "card", F.substring(d, 1, 1).try_cast("int")).otherwise(-1), "f_luhn": (F.length(d) >= 2).cast("int") * F.coalesce(F.call_function("luhn_check", d).cast("int"), F.lit(0)),
        "f_slash": F.length(m) - F.length(F.replace(m, F.lit("/"), F.lit(""))), "f_hidden": F.size(F.regexp_extract_all(m, F.lit(r"[\(\[\{](?:at|dot|\.)[\)\]\}]"), F.lit(0))), "f_zeros": m.startswith("00").cast("int"),
        "f_date": m.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?:[^0-9]|$)").cast("int"), "f_thousands": m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$").cast("int"), "f_last": coarse(F.length(F.regexp_extract(m, "[0-9]+$", 0))),
        "f_under": F.length(m) - F.length(F.replace(m, F.lit("_"), F.lit(""))), "f_issued": m.rlike(ISSUED).cast("int"), "f_hex": m.rlike("^[0-9a-f]+$").cast("int"), "f_upper": coarse(F.length(F.regexp_replace(m, "[^A-Z]", ""))), "f_distinct": coarse(F.size(F.array_distinct(F.split(F.left(m, F.lit(256)), "")))), "f_given": before.rlike("[=:] ?[\"']?$").cast("int"), "f_quoted": before.rlike("[\"']$").cast("int"),
        "f_large_part": F.exists(F.split(m, r"[^0-9]+"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)) > 255).cast("int"),
        "f_glued_left": before.rlike(r"[A-Za-z0-9]$").cast("int"), "f_glued_right": F.col("after").rlike("^[A-Za-z0-9]").cast("int"),
        **{f"f_is_{k}": (F.col("kind") == k).cast("int") for k in ALL_KINDS},
    }
    return c.withColumns({"word": _word(), **{k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in cols.items()}}), list(cols)


def find(docs: DataFrame, text: str = "text", seed: int = 5) -> DataFrame:
    """(doc_id, th, spans) for each row with findings; spans: array of (k, start, end, base, p), by kind and start.

    Base spans are the rules'. Wider generators propose overlapping candidates; gradient-boosted trees, fitted here on
    all labelled rows (those alike in features summed into one that has their weight), score them by format and by how often the word before them stands before such spans. Positive labels: candidates that equal a validated base
    span of their kind, and such spans rewritten into forms that the rules miss, where they stand. Negative: candidates that equal a base span of another
    kind, rule matches and untouched candidates that fail validation, plain runs of digits, number forms built from the spans' digits, and failed
    matches laid out so that they pass (`repaired`). Other candidates that touch no base span have no label and are what the trees decide
    on, if they can be what their kind says (`plausible`). A kind's threshold lies midway between the lowest score whose precision reaches PRECISION on
    its rows held out of the fit, with all forms of a span on one side, and the score below, but no lower than EVEN; a kind without both labels there gets no additions.
    A candidate over the threshold that overlaps no base span is added, the longest for each kind and start. Keys and tokens (secret) have
    no rule; their candidates are runs of letters and digits, decided by format, by how issued keys begin and by the words before them.

    Null and empty texts have no findings; rows alike in doc_id and text share theirs; a null doc_id is an id like others. Texts of any length
    are searched whole; other columns play no part, whatever their names. Empty input: empty result.
    """
    found = materialize(candidates(docs, text), "pii-candidates")
    base = found.where("base and ok").groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "start", "end")).alias("rules"))  # one document's spans
    wide = found.where("not base").join(base.withColumnsRenamed({"doc_id": "bd", "th": "bt"}), F.col("doc_id").eqNullSafe(F.col("bd")) & F.col("th").eqNullSafe(F.col("bt")), "left").drop("bd", "bt")
    rules = F.coalesce("rules", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    same = F.exists(rules, lambda r: (r["kind"] == F.col("kind")) & (r["start"] == F.col("start")) & (r["end"] == F.col("end")))
    touches = F.exists(rules, lambda r: (r["start"] < F.col("end")) & (F.col("start") < r["end"]))
    other = F.exists(rules, lambda r: (r["kind"] != F.col("kind")) & (r["start"] == F.col("start")) & (r["end"] == F.col("end")))
    plain = F.col("m").rlike("^[0-9]+$") & ~((F.col("kind") == "phone") & F.col("m").startswith("00")) & ((F.col("kind") != "card") | ~F.col("ok"))
    no = other | (~touches & (plain | ~plausible(F.col("kind"), F.col("m"))))
    wide = wide.withColumn("label", F.when(same, 1.0).when(no, 0.0)).withColumn("touches", touches).drop("rules")
    wide = materialize(wide, "pii-wide")
    failed = found.where("base and not ok").withColumn("label", F.lit(0.0))
    seen = wide.where("label is not null").unionByName(failed, allowMissingColumns=True).select("kind", "m", "before", "after", F.col("m").alias("origin"), "label")
    of = origins(found)
    labelled = seen.unionByName(rewritten(of)).unionByName(repaired(of)).withColumn("order", F.xxhash64(F.lit(seed), "kind", "origin"))
    rows, names = _features(labelled)
    # of a fifth of the rows the word is left out, as it is where no labelled row has it
    rows = rows.select("kind", "label", "word", (F.pmod("order", F.lit(4)) == 0).alias("held"), (F.pmod("order", F.lit(5)) == 0).alias("blank"), *names)
    sums = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "pii-labelled")
    sums = weighed(sums)
    words = materialize(word_odds(sums.where("not held")), "pii-words")
    words = broadcast_within(words, F.octet_length("ww") + 64)
    known = _with_odds(sums.withColumn("word", F.when(~F.col("blank"), F.col("word"))), words)
    names = [*names, "f_word"]
    sample = materialize(known.groupBy("kind", "label", "held", *names).agg(F.round(F.sum("w"), 9).alias("w")), "pii-training")
    assemble = VectorAssembler(inputCols=names, outputCol="features").transform
    fitted, held = assemble(sample.where("not held")), assemble(sample.where("held"))
    spans = found.where("base and ok").select("doc_id", "th", F.col("kind"), "start", "end", F.lit(True).alias("base"), F.lit(1.0).alias("p"))
    sides = [r["count"] for r in sample.where("not held").groupBy("label").count().collect()]  # two rows
    if len(sides) == 2:
        bins = max(32, math.isqrt(sum(sides)) + 1)  # Spark finds splits on a sample of bins * bins rows: with so many bins on all of them
        fitted = fitted.coalesce(1).sortWithinPartitions("kind", "label", *names) if sum(sides) <= ORDERED_ROWS else fitted
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="w", maxBins=bins, maxIter=20, maxDepth=5, seed=seed).fit(fitted)
        score = F.round(vector_to_array(F.col("probability"))[1], 6)
        cuts = model.transform(held).groupBy("kind", score.alias("p")).agg(F.sum(F.col("label") * F.col("w")).alias("hits"), F.sum("w").alias("n"))
        above = Window.partitionBy("kind").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over scores of six decimals
        both = F.size(F.collect_set(F.col("hits") > 0).over(Window.partitionBy("kind"))) == 2  # a score with positives and one without
        middle = (F.col("p") + F.coalesce(F.lead("p").over(Window.partitionBy("kind").orderBy(F.col("p").desc())), F.col("p"))) / 2
        cuts = cuts.select("kind", "p", middle.alias("middle"), both.alias("both"), (F.sum("hits").over(above) / F.sum("n").over(above)).alias("precision")).where(F.col("both") & (F.col("precision") >= PRECISION))
        cut = {r["kind"]: max(r["p"], EVEN) for r in cuts.groupBy("kind").agg(F.min_by("middle", "p").alias("p")).collect()}  # a row for each kind
        if cut:
            least = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(cut[k])), cut, F.when(F.lit(False), F.lit(0.0)))
            scored = model.transform(assemble(_with_odds(_features(wide.where("not touches and label is null"))[0], words))).withColumn("p", score).where(F.col("p") >= least)
            longest = scored.groupBy("doc_id", "th", "kind", "start").agg(F.max_by("end", "end").alias("end"), F.max_by("p", "end").alias("p"))
            spans = spans.union(longest.select("doc_id", "th", "kind", "start", "end", F.lit(False), "p"))
    k = reduce(lambda a, i: a.when(F.col("kind") == ALL_KINDS[i], i), range(1, len(ALL_KINDS)), F.when(F.col("kind") == ALL_KINDS[0], 0))
    span = F.struct(k.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base", "p")
    return spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(span)).alias("spans"))
