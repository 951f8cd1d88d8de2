"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a predicate over measures of a text; a measure is SQL over the text and its words. On a random
sample the cascade adds up the work of every rule and counts what it rejects, orders the rules by
rejection per cost, and evaluates them as one CASE. A measure is written into the branches that ask
for it and nowhere else, so a rejected text never pays for the rules behind: the repeated 8-word
windows, by far the dearest measure, are only looked for in texts that every cheaper rule passed.
The order changes what is computed, never which rows are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import table, work_table

WINDOW = 8
SAMPLE_ROWS = 1000
WORDS = r"array_remove(split({t}, '[\\x20\\x09-\\x0D]+'), '')"
_lines = r"filter(split({t}, '\n'), line -> line RLIKE '[^\\x20\\x09-\\x0D]')"
_left = "CAST(char_length(regexp_replace({t}, '{x}', '')) AS BIGINT)"  # characters left when a pattern is removed

#: Words inside 8-word windows that occur twice or more in the same text. Windows compare by the 64-bit
#: hash of their word list (in a text of a million words two different ones meet with probability 3e-8).
#: Only a text with an equal pair is sorted: equal neighbours in (hash, place) order are the repeated
#: windows, and one pass over their places adds up the words they cover.
_repeats = f"""element_at(transform(
  array(CASE WHEN size({{w}}) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(1, size({{w}}) - {WINDOW - 1}), i -> xxhash64(slice({{w}}, i, {WINDOW}))) END),
  windows -> CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE element_at(transform(
    array(sort_array(transform(windows, (h, i) -> struct(h AS h, i AS place)))),
    s -> aggregate(
      array_sort(filter(
        transform(s, (x, i) -> CASE WHEN (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h) THEN x.place END),
        place -> place IS NOT NULL)),
      named_struct('words', 0L, 'upto', 0),
      (sum, place) -> named_struct('words', sum.words + place + {WINDOW} - greatest(place, sum.upto), 'upto', place + {WINDOW}),
      sum -> sum.words)), 1) END), 1)"""

#: Measure -> SQL over {t}, the text, and {w}, the array of its words.
MEASURES = {
    "n_words": "CAST(size({w}) AS BIGINT)",
    "word_chars": "CAST(char_length(array_join({w}, '')) AS BIGINT)",
    "n_symbols": _left.replace("{x}", "[^#*$%&|<>]+"),
    "n_lines": f"CAST(size({_lines}) AS BIGINT)",
    "n_dup_lines": f"element_at(transform(array({_lines}), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT)), 1)",
    "n_repeat_words": _repeats,
    "n_exclamations": _left.replace("{x}", "[^!]+"),
    "n_upper": _left.replace("{x}", r"[^\\p{Lu}]+"),
    "n_letters": _left.replace("{x}", r"[^\\p{L}]+"),
}
#: What op7's contract returns of every text, rejected or not.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Work of a measure: characters and array elements that it touches, those that a pattern or a hash looks at
#: REGEX-fold. It depends on the text alone, so that costs, and the order with them, are the same on any machine.
REGEX = 4
_chars, _word = "char_length({t})", "size({w})"
_by_line = f"({REGEX} * {_chars} + size(split({{t}}, '\\n')))"
WORK = {
    "n_words": "1",
    "word_chars": f"({_chars} + {_word})",
    "n_symbols": f"{REGEX} * {_chars}",
    "n_lines": _by_line,
    "n_dup_lines": f"(2 * {_by_line})",
    "n_repeat_words": f"({WINDOW * REGEX} * {_chars} + {_word})",  # a hash looks at every character once for each window that holds it
    "n_exclamations": f"{REGEX} * {_chars}",
    "n_upper": f"{REGEX} * {_chars}",
    "n_letters": f"{REGEX} * {_chars}",
}


def measure(name: str, text: str, words: str) -> str:
    return MEASURES[name].replace("{t}", text).replace("{w}", words)


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL predicate over measures, written in angle brackets."""

    name: str
    rejects: str

    def sql(self, text: str, words: str, known: tuple[str, ...] = ()) -> str:
        """The predicate, with measures written out; those in ``known`` are columns already."""
        out = self.rejects
        for name in MEASURES:
            out = out.replace(f"<{name}>", name if name in known else f"({measure(name, text, words)})")
        return out

    def work(self, text: str, words: str) -> str:
        """SQL: the work of the predicate on one text, every use of a measure counted."""
        parts = [f"{self.rejects.count(f'<{m}>')} * {w}" for m, w in WORK.items() if f"<{m}>" in self.rejects]
        return " + ".join(parts or ["1"]).replace("{t}", text).replace("{w}", words)


#: Production rules of the method. Shares are of words, lines or letters of the whole text.
RULES = (
    Rule("symbols", "<n_symbols> > 0.1 * <n_words>"),
    Rule("long_words", "<word_chars> > 40 * <n_words>"),
    Rule("repeated_lines", "<n_dup_lines> > 0.4 * <n_lines>"),
    Rule("exclamations", "<n_exclamations> > 0.5 * <n_words>"),
    Rule("shouting", "<n_letters> >= 20 AND <n_upper> > 0.5 * <n_letters>"),
)
BASE = (Rule("few_words", "<n_words> < 20"), Rule("repeats", "100 * <n_repeat_words> > 30 * <n_words>"))
#: For filtering a corpus: a short clean text stays, and so does a line that a text of under 40 words
#: says twice; a short text that is one sentence over and over goes.
STAGE_BASE = (Rule("no_words", "<n_words> = 0"), Rule("repeats", "100 * <n_repeat_words> > CASE WHEN <n_words> < 40 THEN 60 ELSE 30 END * <n_words>"))


def _cased(rules: list[Rule], text: str, words: str, known: tuple[str, ...] = ()) -> str:
    """The name of the first rule that rejects the text, else null."""
    return "CASE " + " ".join(f"WHEN {r.sql(text, words, known)} THEN '{r.name}'" for r in rules) + " END"


def first_failed(rules: list[Rule], text: str = "text") -> str:
    """SQL: the first rule that rejects ``text``, else null. Words are bound once; measures are written
    out inside the branches."""
    return f"element_at(transform(array({WORDS.replace('{t}', text)}), words -> {_cased(rules, text, 'words')}), 1)"


def ordered(rules: tuple[Rule, ...], sample: DataFrame) -> list[Rule]:
    """Rules by share rejected per cost on ``sample`` (text), best first; ties go by cost, then name. Cost is
    the mean work of a text. One pass over the sample; the same sample gives the same order."""
    rows = sample.select("text", F.expr(WORDS.replace("{t}", "text")).alias("words"))
    rejected = [F.coalesce(F.avg(F.expr(f"CASE WHEN {r.sql('text', 'words')} THEN 1 ELSE 0 END")), F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]
    work = [F.coalesce(F.avg(F.expr(r.work("text", "words"))), F.lit(0.0)).alias(f"w{i}") for i, r in enumerate(rules)]
    found = rows.agg(*rejected, *work).first()
    cost = [max(found[f"w{i}"], 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-found[f"r{i}"] / cost[i], cost[i], rules[i].name))]


def order_for(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The order of ``rules`` on a random sample of about ``sample_rows`` rows, which only bounds what the
    order is estimated from."""
    texts = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    share = min(1.0, sample_rows / max(docs.count(), 1))
    return ordered(rules, work_table(texts.sample(share, seed=7).coalesce(1), "rule-sample"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, words, and the REPORTED measures), one row per input row. A null text has no words
    and no lines. Repeated rows and null ids stay; other columns are ignored."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(WORDS.replace("{t}", "text")))
    return rows.select("doc_id", "text", "words", *[F.expr(measure(m, "text", "words")).alias(m) for m in REPORTED])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the REPORTED measures, base_failed, failed): ``failed`` is the first rule of the cascade
    that rejects the text (base rules among them), else null.

    The reported measures are computed for every row, as they are returned; those that only rules ask for
    are computed in their branches. Long texts are judged whole; a null or empty text has no words. An
    empty table gives no rows.
    """
    order = order_for(docs, (*base, *rules), text_col)
    found = measures(docs, id_col, text_col)
    failed = F.expr(_cased(order, "text", "words", REPORTED))
    base_failed = F.expr(" OR ".join(r.sql("text", "words", REPORTED) for r in base))
    return found.select("doc_id", *REPORTED, base_failed.alias("base_failed"), failed.alias("failed"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = STAGE_BASE) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that no rule rejects, for filtering a corpus.

    One predicate over the raw text, in the measured order. Every column returns as it was; null and
    wordless texts go; repeated rows are judged each by itself.
    """
    order = order_for(docs, (*base, *rules))
    text = "coalesce(text, '')"
    return docs.where(F.expr(f"{first_failed(order, text)} IS NULL"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict of every row of ``documents``."""
    return judged(table(spark, sf_dir, "documents")).withColumn("kept", F.col("failed").isNull()).drop("failed")


OP7_SQL = """
WITH w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
p AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM p) WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_excl, length(regexp_replace(t, '[^\\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{L}]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > 0.1 * n_words OR word_chars > 40 * n_words OR n_dup_lines > 0.4 * n_lines
            OR n_excl > 0.5 * n_words OR (n_upper > 0.5 * n_letters AND n_letters >= 20)) AS kept
FROM m
"""
