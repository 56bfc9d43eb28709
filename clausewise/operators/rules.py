"""Rules as column expressions over sentence rows.

Each builder takes a ``Context`` and returns a column of ``array<finding>``. A sentence rule reads one row,
which also carries what the parser noted of its block and list, and needs no shuffle; all are
concatenated and exploded once. The first use of a long noun (1.9) and the steps of a procedure (5.3)
ask for a whole document: where they can occur, one shuffle of the findings decides them (``settled``).

A finding is (rule_id, message, severity, confidence, start, end, suggestion); positions are code
points of the document. ``order`` and ``emitted`` keep the catalogue's order among findings that
tie on position and rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewise.functions import lexicon as L
from clausewise.options import Options

from .parsing import PARAGRAPH

FINDING = "struct<rule_id:string,message:string,severity:string,confidence:double,start:int,end:int,suggestion:string>"
QUOTES = "\"'`‘’“”"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(s: str) -> Column:
    return F.lit(s)


def finding(rule_id: str, severity: str, confidence: Column | float, start: Column, end: Column, message: Column, advice: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        lit(advice).alias("suggestion"),
    )




def nothing() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def present(found: Column) -> Column:
    return F.filter(found, lambda f: f.isNotNull())


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


@dataclass
class Context:
    """Columns of a sentence row, and whether tokens carry grammar."""

    options: Options
    tagged: bool = False

    tokens = property(lambda self: F.col("tokens"))
    start = property(lambda self: F.col("start"))

    def __post_init__(self) -> None:
        self.allow = sorted(self.options.allowed)

    def tok(self, i: Column) -> Column:
        return F.get(self.tokens, i)

    def low(self, i: Column) -> Column:
        return F.get(self.tokens, i)["lower"]

    def size(self) -> Column:
        return F.size(self.tokens)

    def allowed(self, word: Column) -> Column:
        return F.lower(word).isin(self.allow) if self.allow else F.lit(False)

    def source(self, start: Column, end: Column) -> Column:
        """Source text of a span of this sentence."""
        return F.substr(F.col("text"), start - self.start + 1, end - start)

    def span(self, i: Column, j: Column) -> Column:
        """Source between two tokens on one line."""
        return F.trim(F.regexp_replace(self.source(self.tok(i)["start"], self.tok(j)["end"]), "\\s+", " "))

    def each(self, wanted: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
        """``make(token, index)`` for tokens that are wanted; nulls are dropped."""
        return present(F.transform(self.tokens, lambda t, i: F.when(wanted(t), make(t, i))))

    def filler(self, t: Column) -> Column:
        low = t["lower"]
        return low.isin(sorted(L.INTERRUPTERS)) | ((F.length(low) > 3) & low.endswith("ly"))

    def next_content(self, i: Column) -> Column:
        """Index of the first token at or after ``i`` that is no filler; the size if there is none."""
        rest = F.slice(self.tokens, i + 1, F.greatest(self.size() - i, F.lit(0)))
        skip = F.array_position(F.transform(rest, self.filler), False)
        return F.when(skip > 0, i + skip - 1).otherwise(self.size()).cast("int")

    def joined(self, i: Column, j: Column) -> Column:
        """Whether no hidden word and no quotation mark stands between tokens ``i`` and ``j``."""
        gap = lambda k: self.source(self.tok(k)["end"], self.tok(k + 1)["start"])
        clean = F.forall(F.sequence(i, j - 1), lambda k: ~gap(k).rlike(f"[A-Za-z0-9{QUOTES}]"))
        return (j > i) & F.when(j > i, clean)


def participle(low: Column) -> Column:
    return ~low.contains("-") & (low.isin(sorted(L.IRREGULAR_PARTICIPLES)) | ((F.length(low) > 3) & low.endswith("ed")))


def ing_form(low: Column) -> Column:
    return ~low.contains("-") & (F.length(low) > 4) & low.endswith("ing")


def quote(c: Column, tail: str) -> Column:
    return F.concat(F.lit('"'), c, F.lit(f'" {tail}'))


def words_array(phrase: str) -> Column:
    return F.array(*[F.lit(w) for w in phrase.split()])


def phrase_at(c: Context, i: Column, phrases: Iterable[str]) -> Column:
    """Positions in ``phrases`` of those that start at token ``i``, in their order."""
    hits = [F.when(F.transform(F.slice(c.tokens, i + 1, len(p.split())), lambda t: t["lower"]) == words_array(p), k) for k, p in enumerate(phrases)]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


# --- sentence rules, in catalogue order ---------------------------------------------------------


def sentence_length(c: Context) -> Column:
    limit = F.lit(c.options.max_words) if c.options.max_words > 0 else F.when(F.col("procedural") & ~F.col("note"), 20).otherwise(25)
    over = lambda n, what: F.concat(F.lit(f"{what} of "), n.cast("string"), F.lit(" words is over the limit of "), limit.cast("string"), F.lit(" words."))
    groups = F.transform(
        F.filter("groups", lambda g: g["words"] > limit),
        lambda g: finding("STE-5.1", "warning", 0.9, g["start"], g["end"], over(g["words"], "A parenthesis"), "Write the parenthesis as a sentence."),
    )
    words = F.col("name_words") if c.tagged else F.col("words")
    whole = F.when(words > limit, F.array(finding("STE-5.1", "warning", 0.9, F.col("start"), F.col("end"), over(words, "A sentence"), "Divide the sentence."))).otherwise(nothing())
    return F.concat(groups, whole)


def semicolons(c: Context) -> Column:
    """Semicolons of the prose that do not end an HTML entity."""
    parts = F.split(F.col("masked"), ";")
    start = lambda k: F.aggregate(F.slice(parts, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x) + 1)
    found = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: ~F.get(parts, k).rlike("&[A-Za-z0-9#]{1,10}$")),
        lambda k: finding("STE-8.1", "warning", 1.0, F.col("start") + start(k) - 1, F.col("start") + start(k), text("A semicolon is not approved."), "Write two sentences or a list."),
    )
    return F.when(F.col("masked").contains(";"), found).otherwise(nothing())


def contractions(c: Context) -> Column:
    ends = ("n't", "'re", "'ve", "'ll", "'m", "'d")

    def wanted(t: Column) -> Column:
        low = t["lower"]
        hit = low.isin(sorted(L.S_CONTRACTIONS))
        for e in ends:
            hit = hit | (low.endswith(e) & (F.length(low) > len(e)))
        return low.contains("'") & hit

    full = lambda t: lookup(L.CONTRACTION_EXPANSIONS, t["lower"])
    return c.each(wanted, lambda t, i: finding("STE-4.2", "warning", 0.98, t["start"], t["end"], quote(t["text"], "is a contraction."), F.coalesce(F.concat(F.lit('Write "'), full(t), F.lit('".')), F.lit("Write the full form."))))


def perfect(c: Context) -> Column:
    def make(t: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            out = lambda k, confidence: finding("STE-3.4", "warning", confidence, t["start"], c.tok(k)["end"], quote(c.span(i, k), "is a perfect tense."), "Write the simple past or the simple present.")
            longer = let(c.next_content(j + 1), lambda k: F.when((k < c.size()) & (participle(c.low(k)) | ing_form(c.low(k))), out(k, 0.9)).otherwise(out(j, 0.55)))
            return F.when((j < c.size()) & c.joined(i, j) & (c.low(j) != "to"), F.when(c.low(j) == "been", longer).when(participle(c.low(j)), out(j, 0.9)))

        return let(c.next_content(i + 1), at)

    return c.each(lambda t: t["lower"].isin(sorted(L.PERFECT_AUX)) & ~c.allowed(t["lower"]), make)


def planned(c: Context) -> Column:
    def make(t: Column, i: Column) -> Column:
        def at(k: Column) -> Column:
            ok = (k < c.size()) & c.joined(i, k) & participle(c.low(k))
            confidence: Column = F.lit(0.85)
            if c.tagged:
                tag = c.tok(k)["tag"]
                ok = ok & (~F.col("tagged") | (tag == "") | (tag == "VBN"))
                confidence = F.when(F.col("tagged") & (tag != ""), 0.9).otherwise(0.85)
            return F.when(ok, finding("STE-3.4", "warning", confidence, t["start"], c.tok(k)["end"], quote(c.span(i, k), "has more than one auxiliary verb."), "Write a command or the active voice."))

        return F.when((c.low(i + 1) == "to") & (c.low(i + 2) == "be"), let(c.next_content(i + 3), at))

    return c.each(lambda t: t["lower"].isin("am", "are", "is", "was", "were") & ~c.allowed(t["lower"]), make)


def progressive(c: Context) -> Column:
    def make(t: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            w = c.low(j)
            ok = (j < c.size()) & c.joined(i, j) & ing_form(w) & ~w.isin(sorted(L.ADJECTIVAL_ING)) & ~c.allowed(w) & (w != "being")
            return F.when(ok, finding("STE-3.5", "warning", 0.9, t["start"], c.tok(j)["end"], quote(c.span(i, j), "is a progressive form."), "Write the simple present or the simple past."))

        return let(c.next_content(i + 1), at)

    return c.each(lambda t: t["lower"].isin(sorted(L.BE_FORMS)) & ~c.allowed(t["lower"]), make)


def passive(c: Context, outer: Column) -> Column:
    """Passive forms, without those inside a perfect form unless a by-agent follows."""

    def make(t: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            w = c.low(j)
            agent = F.coalesce(c.low(j + 1) == "by", F.lit(False))
            inside = F.exists(outer, lambda p: (p["start"] <= t["start"]) & (p["end"] >= c.tok(j)["end"]))
            ok = (j < c.size()) & c.joined(i, j) & participle(w) & ~c.allowed(w) & (agent | ~w.isin(sorted(L.ADJECTIVAL_PARTICIPLES))) & (agent | ~inside)
            confidence = F.when(agent, 0.95).when(w.isin(sorted(L.IRREGULAR_PARTICIPLES)), 0.85).otherwise(0.7)
            if c.tagged:
                verb = F.get(F.filter("syntax", lambda x: x["start"] == c.tok(j)["start"] - c.start), F.lit(0))
                dep = F.exists("syntax", lambda x: (x["head"] == verb["index"]) & x["dep"].isin("auxpass", "nsubjpass", "csubjpass"))
                ok = ok & F.when(verb.isNull(), True).otherwise(dep)
                confidence = F.when(verb.isNotNull(), F.greatest(confidence, F.lit(0.9))).otherwise(confidence)
            return F.when(ok, finding("STE-3.6", "warning", confidence, t["start"], c.tok(j)["end"], quote(c.span(i, j), "is the passive voice."), "Write the active voice."))

        return let(c.next_content(i + 1), at)

    return c.each(lambda t: t["lower"].isin(sorted(L.BE_FORMS)) & ~c.allowed(t["lower"]), make)


PHRASAL: dict[str, list[tuple[str, str]]] = {}
for (_verb, _particles), _advice in L.PHRASAL_VERBS.items():
    for _form in L.VERB_FORMS[_verb].split():
        PHRASAL.setdefault(_form, []).append((_particles, _advice))
_ROWS = {f"{form} {p}": advice for form, rows in PHRASAL.items() for p, advice in rows}
_PARTICLES = sorted({p for rows in PHRASAL.values() for p, _ in rows}, key=lambda p: (-len(p.split()), p))


def up_to_amount(c: Context, last: Column) -> Column:
    amount = c.low(last + 2)
    return F.coalesce((c.low(last) == "up") & (c.low(last + 1) == "to") & (amount.rlike("^\\p{Nd}") | amount.isin(sorted(L.AMOUNT_WORDS))), F.lit(False))


def phrasal(c: Context) -> Column:
    """A verb form and its particles side by side; a lookup of verb and particles, shortest particles first."""

    def make(t: Column, i: Column) -> Column:
        def at(n: int) -> Column:
            key = F.concat_ws(" ", t["lower"], *[c.low(i + k) for k in range(1, n + 1)])
            last = i + n
            ok = (last < c.size()) & key.isin(sorted(k for k in _ROWS if len(k.split()) == n + 1)) & ~up_to_amount(c, last) & ~c.allowed(c.span(i, last))
            return F.when(ok, finding("STE-9.3", "warning", 0.85, t["start"], c.tok(last)["end"], quote(c.span(i, last), "is a phrasal verb."), lookup(_ROWS, key)))

        return F.coalesce(at(1), at(2))

    return c.each(lambda t: t["lower"].isin(sorted(PHRASAL)) & ~c.allowed(t["lower"]), make)


def verbs(c: Context) -> Column:
    """Perfect and planned forms by trigger, then passives, then progressive and phrasal forms by trigger."""
    both = F.array_sort(F.concat(perfect(c), planned(c)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    other = F.array_sort(F.concat(progressive(c), phrasal(c)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return let(both, lambda p: F.concat(p, passive(c, p), other))


def determiner_before(c: Context, i: Column) -> Column:
    """Whether one of the last three words is a determiner, with no stopper after it."""

    def back(k: int) -> Column:
        low = c.low(i - k)
        hit = low.isin(sorted(L.DETERMINERS)) | low.endswith("'s")
        step = F.when(F.coalesce(hit, F.lit(False)), True).when(F.coalesce(low.isin(sorted(L.PHRASE_STOPPERS)), F.lit(False)), False)
        return step.otherwise(back(k + 1) if k < 3 else F.lit(False))

    return back(1)


def greedy(candidates: Column) -> Column:
    """Keeps (at, size, f) candidates from left to right; a kept one takes its words."""
    state = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{FINDING}>").alias("out"))
    step = lambda a, x: F.when(x["at"] >= a["next"], F.struct((x["at"] + x["size"]).alias("next"), F.concat(a["out"], F.array(x["f"])).alias("out"))).otherwise(a)
    return F.aggregate(candidates, state, step, lambda a: a["out"])


def phrase_candidates(c: Context, phrases: dict[str, str], rule: str, tail: str, advice: Callable[[str], str], permits: bool) -> Column:
    names = list(phrases)
    sizes = F.array(*[F.lit(len(p.split())) for p in names])
    advices = F.array(*[F.lit(advice(phrases[p])) for p in names])
    firsts = sorted({p.split()[0] for p in names})

    def make(t: Column, i: Column) -> Column:
        def one(k: Column) -> Column:
            n = F.get(sizes, k)
            last = i + n - 1
            f = finding(rule, "warning", 0.9, t["start"], c.tok(last)["end"], quote(c.span(i, last), tail), F.get(advices, k))
            return F.when(~c.allowed(c.span(i, last)) if permits else F.lit(True), F.struct(i.alias("at"), n.alias("size"), f.alias("f")))

        return F.get(present(F.transform(phrase_at(c, i, names), one)), F.lit(0))

    return c.each(lambda t: t["lower"].isin(firsts), make)


def by_position(candidates: Column) -> Column:
    """Sorted by position; of several at one position the longer comes first (a group before a word)."""
    rank = lambda x: x["at"] * 64 - x["size"]
    return F.array_sort(candidates, lambda a, b: rank(a) - rank(b))


def terms(c: Context) -> Column:
    groups = phrase_candidates(c, L.BANNED_PHRASES, "STE-1.1", "is not an approved word group.", lambda r: f'Write "{r}".', True)

    def one(t: Column, i: Column) -> Column:
        r = t["rejected"]
        known = r.isNotNull()
        noun_like = determiner_before(c, i)
        confidence = F.when(r["only_verb"], 0.6).otherwise(0.95)
        dropped = r["only_verb"] & noun_like
        if c.tagged:
            pos = F.when(F.col("tagged"), t["pos"]).otherwise("")
            dropped = r["only_verb"] & (pos.isin("NOUN", "ADJ") | ((pos != "VERB") & noun_like))
            confidence = F.when(r["only_verb"] & (pos != "VERB"), 0.6).otherwise(0.95)
        advice = F.when(F.size(r["alternatives"]) > 0, F.concat(F.lit('Write "'), F.array_join(r["alternatives"], '", or "'), F.lit('".')))
        advice = advice.when(r["technical_noun"], F.lit("The dictionary approves this word as a technical noun only.")).otherwise("Write the idea in approved words.")
        by_dictionary = finding("STE-1.1", "warning", confidence, t["start"], t["end"], quote(t["text"], "is not an approved word."), advice)
        banned = t["lower"].isin(sorted(L.BANNED_WORDS))
        by_list = finding("STE-1.1", "warning", 0.9, t["start"], t["end"], quote(t["text"], "is not an approved word."), F.concat(F.lit('Write "'), lookup(L.BANNED_WORDS, t["lower"]), F.lit('".')))
        return F.struct(i.alias("at"), F.lit(1).alias("size"), F.when(known & ~dropped, by_dictionary).when(banned, by_list).alias("f"))

    single = c.each(lambda t: (t["rejected"].isNotNull() | t["lower"].isin(sorted(L.BANNED_WORDS))) & ~c.allowed(t["lower"]), one)
    single = F.filter(single, lambda x: x["f"].isNotNull())
    return greedy(by_position(F.concat(groups, single)))


def spelling(c: Context) -> Column:
    def make(t: Column, i: Column) -> Column:
        f = finding("STE-1.14", "warning", 0.9, t["start"], t["end"], quote(t["text"], "is a British spelling."), F.concat(F.lit('Write "'), lookup(L.BRITISH_SPELLINGS, t["lower"]), F.lit('".')))
        return F.when((i == 0) | ~t["text"].rlike("^\\p{Lu}"), f)

    return c.each(lambda t: t["lower"].isin(sorted(L.BRITISH_SPELLINGS)) & ~c.allowed(t["lower"]), make)


def nominalizations(c: Context) -> Column:
    return greedy(by_position(phrase_candidates(c, L.NOMINALIZATIONS, "STE-3.7", "uses a noun for an action.", lambda r: f'Write "{r}".', False)))


def latin(c: Context) -> Column:
    after = lambda t: F.substr(F.concat("text", "after"), t["end"] - c.start + 1, F.lit(1))
    wanted = lambda t: t["lower"].isin(sorted(L.LATIN_ABBREVIATIONS)) & (t["text"] == t["lower"]) & (after(t) == ".") & ~c.allowed(t["lower"])
    return c.each(wanted, lambda t, i: finding("STE-GR-6", "info", 0.9, t["start"], t["end"], quote(t["text"], "is a Latin abbreviation."), F.concat(F.lit('Write "'), lookup(L.LATIN_ABBREVIATIONS, t["lower"]), F.lit('".'))))


def instruction_word(c: Context) -> Column:
    """The first word that makes a sentence an instruction, or null."""
    hit = F.transform(c.tokens, lambda t, i: F.when(t["lower"].isin(sorted(L.INSTRUCTION_WORDS)) & ((t["lower"] != "do") | F.coalesce(c.low(i + 1) == "not", F.lit(False))), t))
    return F.get(present(hit), F.lit(0))


def note_instruction(c: Context) -> Column:
    def of(t: Column) -> Column:
        return F.when(t.isNotNull(), F.array(finding("STE-5.5", "warning", 0.8, t["start"], t["end"], F.concat(F.lit('A note has an instruction: "'), t["text"], F.lit('".')), "Move the instruction to a step of the procedure."))).otherwise(nothing())

    return F.when(F.col("note"), let(instruction_word(c), of)).otherwise(nothing())


def condition_order(c: Context) -> Column:
    """The first condition after the command; a condition at the start ends the search."""
    conditions = sorted(L.CONDITION_WORDS)
    marker = lambda t: t["lower"].isin(sorted(L.CLAUSE_MARKERS)) | ((F.length(t["lower"]) > 3) & t["lower"].rlike("e[ds]$"))

    def make(t: Column, i: Column) -> Column:
        ok = (i >= 3) & ~c.low(i - 1).isin(sorted(L.CLAUSE_VERBS)) & ~((c.low(i - 2) == "to") & c.tok(i - 1)["text"].rlike("^[a-z]"))
        later = F.exists(F.slice(c.tokens, i + 2, F.greatest(c.size() - i - 1, F.lit(0))), marker)
        f = finding("STE-5.4", "info", 0.7, t["start"], c.tok(c.size() - 1)["end"], F.concat(F.lit('The condition ("'), t["text"], F.lit('") comes after the command.')), "Write the condition first, then a comma, then the command.")
        return F.when(ok & later, f)

    found = F.slice(c.each(lambda t: t["lower"].isin(conditions), make), 1, 1)
    return F.when(F.col("procedural") & ~F.col("note") & ~c.low(F.lit(0)).isin(conditions), found).otherwise(nothing())


def name_rows(options: Options) -> list[tuple[str, str]]:
    return [(new, old.lower()) for new, olds in options.prefer for old in olds if old.split()]


def one_name(c: Context) -> Column:
    rows = name_rows(c.options)
    parts = []
    for new, old in rows:
        n = len(old.split())
        hit = lambda t, i, old=old, n=n: F.transform(F.slice(c.tokens, i + 1, n), lambda x: x["lower"]) == words_array(old)
        make = lambda t, i, new=new, n=n, hit=hit: F.when(hit(t, i), finding("STE-1.11", "warning", 0.95, t["start"], c.tok(i + n - 1)["end"], F.concat(quote(c.span(i, i + n - 1), "and "), F.lit(f'"{new}" name the same item.')), f'Write "{new}".'))
        parts.append(c.each(lambda t, old=old: t["lower"] == old.split()[0], make))
    return F.concat(*parts) if parts else nothing()


def verb_tense(c: Context) -> Column:
    def make(t: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            near = (j < c.size()) & c.joined(i, j)
            w = c.low(j)

            def perfect_after(k: Column) -> Column:
                return (k < c.size()) & c.joined(j, k) & (c.low(k) != "to") & ((c.low(k) == "been") | participle(c.low(k)))

            is_perfect = near & w.isin(sorted(L.PERFECT_AUX)) & let(c.next_content(j + 1), perfect_after)
            plain = near & ((i == 0) | ~t["text"].rlike("^\\p{Lu}")) & ~w.isin(sorted(L.DETERMINERS | L.SUBJECT_PRONOUNS)) & w.rlike("^\\p{L}+$")
            made = lambda last, confidence: finding("STE-3.2", "warning", confidence, t["start"], c.tok(last)["end"], quote(c.span(i, last), "is not an approved verb form."), lookup(L.MODALS, t["lower"]))
            out = F.when(plain, made(j, 0.8))
            if c.tagged:
                h = t["head"]
                ok = (t["tag"] == "MD") & (h >= 0) & (h != i) & c.tok(h)["pos"].isin("VERB", "AUX")
                chain = near & ((j == h) | ((c.tok(j)["head"] == h) & c.tok(j)["dep"].isin("aux", "auxpass")))
                out = F.when(F.col("tagged") & (t["tag"] != ""), F.when(ok, made(F.when(F.coalesce(chain, F.lit(False)), j).otherwise(i), 0.9))).otherwise(out)
            return F.when(~F.coalesce(is_perfect, F.lit(False)), out)

        return let(c.next_content(i + 1), at)

    return c.each(lambda t: t["lower"].isin(sorted(L.MODALS)) & ~c.allowed(t["lower"]), make)


# --- rules on blocks and lists: the parser has noted what a sentence's neighbours are ------------


def only(found: Column, condition: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(nothing())


def paragraph_length(c: Context) -> Column:
    f = finding("STE-6.6", "warning", 1.0, F.col("start"), F.col("block_end"), F.concat(F.lit("A paragraph has "), F.col("block_n").cast("string"), F.lit(" sentences; the limit is 6.")), "Divide the paragraph.")
    return only(f, F.col("first") & (F.col("kind") == "paragraph") & (F.col("block_n") > PARAGRAPH))


def safety_instruction(c: Context) -> Column:
    f = finding("STE-7.3", "warning", 0.7, F.col("start"), F.col("end"), F.concat(F.lit("The "), F.col("admonition"), F.lit(" does not explain the risk.")), "Add a sentence that gives the risk or the result.")
    return only(f, F.col("admonition").isin(sorted(L.SAFETY_WORDS)) & (F.col("block_n") == 1) & (F.col("block_words") <= 12))


def safety_word(c: Context) -> Column:
    t = c.tok(F.col("risk_at"))
    f = finding("STE-7.1", "warning", 0.7, t["start"], t["end"], F.concat(F.lit("The "), F.col("admonition"), F.lit(' tells of a risk ("'), t["text"], F.lit('") above its level.')), 'Use "warning" for injury or death, and "caution" for damage.')
    return only(f, F.col("risk_at") >= 0)


def vertical_list(c: Context) -> Column:
    letter = F.substr("text", F.lit(1), F.lit(1))
    odd = F.when(F.col("list_lower") <= F.col("list_upper"), letter.rlike("[a-z]")).otherwise(letter.rlike("[A-Z]"))
    f = finding("STE-4.3", "info", 0.8, F.col("start"), F.col("start") + 1, text("A list item starts with another kind of letter than the other items."), "Use the same construction for each item of a list.")
    return only(f, (F.col("list_upper") > 0) & (F.col("list_lower") > 0) & odd)


# --- rules on more than a sentence: its rows are candidates, one shuffle of these decides -------------

STEP = "struct<block:int,tagged:boolean,word:string>"
#: A finding with its place in the report. ``once`` numbers what only its first finding in a document tells,
#: ``step`` is there on the steps of rule 5.3.
CANDIDATE = f"struct<rule_order:int,emitted:int,f:{FINDING},hidden:boolean,once:int,step:{STEP}>"


def short_noun(c: Context) -> Column | None:
    """Uses of technical nouns over the limit: (once, i, f); None without a limit or such nouns."""
    o = c.options
    names = sorted({" ".join(n.lower().split()) for n in (*o.allow_nouns, *o.preset_nouns, *(p for p, _ in o.prefer))})
    names = [n for n in names if len(n.split()) > o.max_noun_words]
    if o.max_noun_words <= 0 or not names:
        return None
    sizes = F.array(*[F.lit(len(n.split())) for n in names])

    def use(i: Column, name: Column) -> Column:
        last = i + F.get(sizes, name) - 1
        f = finding("STE-1.9", "warning", 0.95, c.tok(i)["start"], c.tok(last)["end"], F.concat(F.lit('The technical noun "'), c.span(i, last), F.lit(f'" has more than {o.max_noun_words} words.')), "Select a shorter technical noun.")
        return F.struct(name.alias("once"), i.alias("i"), f.alias("f"))

    starts = sorted({n.split()[0] for n in names})
    return F.flatten(c.each(lambda t: t["lower"].isin(starts), lambda t, i: F.transform(phrase_at(c, i, names), lambda k: use(i, k))))


def step_command() -> Column:
    """Rule 5.3's finding on a step that ``odd_word`` keeps from being a command."""
    w = F.col("odd_word")
    return finding("STE-5.3", "warning", 0.75, w["start"], w["end"], F.concat(F.lit('The instruction starts with "'), w["text"], F.lit('", which is no command verb.')), "Start with the command form of the verb.")


def settled(rows: DataFrame) -> DataFrame:
    """Candidates (CANDIDATE's fields with path and sent_no) that are findings.

    Of those with ``once``, the first in its document; of steps, the odd ones of a procedure (consecutive
    blocks) of at least two, most of which are commands.
    """
    by = ["path", "rule_order"]
    first = F.row_number().over(W.partitionBy(*by, "once").orderBy("sent_no", "emitted"))
    island = F.col("step.block") - F.row_number().over(W.partitionBy(*by).orderBy("step.block"))
    group = W.partitionBy(*by, "island")
    counted = rows.withColumn("island", F.when(F.col("step").isNotNull(), island)).withColumns(
        {
            "first": first,
            "steps": F.count_if("step.tagged").over(group),
            "commands": F.count_if(F.col("step.tagged") & F.col("step.word").isNull()).over(group),
        }
    )
    odd = F.col("step.tagged") & F.col("step.word").isNotNull() & (F.col("steps") >= 2) & (F.col("commands") * 2 > F.col("steps"))
    kept = counted.filter(F.when(F.col("once").isNotNull(), F.col("first") == 1).when(F.col("step").isNotNull(), odd).otherwise(True))
    return kept.withColumn("emitted", F.when(F.col("once").isNotNull(), 0).otherwise(F.col("emitted"))).select(rows.columns)


@dataclass(frozen=True)
class Rule:
    """A catalogue entry. ``top`` is the highest confidence the rule can give, for pruning."""

    name: str
    ids: tuple[str, ...]
    top: float
    sentence: Callable[[Context], Column] | None = None
    #: Gives candidates (once, i, f), of which the first of each ``once`` in a document counts.
    first: Callable[[Context], Column | None] | None = None


#: Rules that need no grammar, in catalogue order with their places among all rules.
RULES: tuple[tuple[int, Rule], ...] = (
    (1, Rule("sentence_length", ("STE-5.1",), 0.9, sentence_length)),
    (2, Rule("semicolons", ("STE-8.1",), 1.0, semicolons)),
    (3, Rule("contractions", ("STE-4.2",), 0.98, contractions)),
    (4, Rule("verbs", ("STE-3.4", "STE-3.5", "STE-3.6", "STE-9.3"), 0.95, verbs)),
    (5, Rule("terms", ("STE-1.1",), 0.95, terms)),
    (6, Rule("spelling", ("STE-1.14",), 0.9, spelling)),
    (7, Rule("nominalizations", ("STE-3.7",), 0.9, nominalizations)),
    (8, Rule("latin_abbreviations", ("STE-GR-6",), 0.9, latin)),
    (9, Rule("paragraph_length", ("STE-6.6",), 1.0, paragraph_length)),
    (10, Rule("note_instruction", ("STE-5.5",), 0.8, note_instruction)),
    (11, Rule("safety_instruction", ("STE-7.3",), 0.7, safety_instruction)),
    (12, Rule("safety_word", ("STE-7.1",), 0.7, safety_word)),
    (13, Rule("vertical_list", ("STE-4.3",), 0.8, vertical_list)),
    (14, Rule("condition_order", ("STE-5.4",), 0.7, condition_order)),
    (15, Rule("one_name", ("STE-1.11",), 0.95, one_name)),
    (16, Rule("short_noun", ("STE-1.9",), 0.95, first=short_noun)),
    (20, Rule("verb_tense", ("STE-3.2",), 0.9, verb_tense)),
)


def wanted(rule: Rule, o: Options) -> bool:
    """Whether a rule can give a finding that survives: plan pruning on the driver."""
    if rule.top < o.confidence or all(i in o.disable or o.severities.get(i) == "off" for i in rule.ids):
        return False
    return rule.name != "one_name" or bool(name_rows(o))
