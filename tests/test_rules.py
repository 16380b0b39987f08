"""Rule semantics: words of our own for every rule class, contexts, alpha values, and a brute-force comparison."""

import random
import time
import unicodedata

import pytest

from phonoweave.functions.features import RuleError, SymbolTable, norm
from phonoweave.functions.inventory import letter_table, phonetic_table
from phonoweave.operators.engine import kernel_once
from phonoweave.plans.kernel import Kernel
from phonoweave.plans.rules import RuleParser, expand_braces, match_bounds
from phonoweave.sources.readers import read_cascade

TABLE = phonetic_table()


def apply(rule: str, word: str, table=TABLE) -> str:
    """Composed, as the words here are written."""
    for r in RuleParser(table).parse(rule):
        word = kernel_once(r, table, word)
    return unicodedata.normalize("NFC", word)


LETTERS = letter_table()

#: (what is shown, rule, word, outcome) over plain letters.
CASES = [
    ("one slot, between others", "[-son,-voi,+cor] > [+voi] / [+syl] __ [+syl]", "# s a t o s t a #", "# s a d o s t a #"),
    ("contexts are those of the word as it was", "[-voi,+lab] > [+voi] / [+voi] __", "# a p p a #", "# a b p a #"),
    ("a matrix to a phone", "[+nas] > l / __ r", "# a n r a m r o n #", "# a l r a l r o n #"),
    ("a matrix to nothing", "[-son,-cont] > ∅ / __ #", "# p a k t #", "# p a k #"),
    ("what follows a deleted segment stays", "[-syl] > ∅ / [-syl] __", "# a b d g l o #", "# a b g o #"),
    ("matrices to one phone", "[+nas] [-son,+lab] > m", "# a n p o m b i #", "# a m o m i #"),
    ("matrices to more phones", "[+syl] [+syl] > i w a", "# k o e t u #", "# k i w a t u #"),
    ("matches do not overlap", "[+syl] [+syl] > y", "# o e a t #", "# y a t #"),
    ("alternatives side by side, the first that fits", "{o u;a;e i} > {u;o;i}", "# t o u k a e i #", "# t u k o i #"),
    ("one insertion for each gap", "∅ > i / [-syl] __ [-syl]", "# a k t r a #", "# a k i t i r a #"),
    ("an insertion at the edge", "∅ > e / # __ s", "# s a s #", "# e s a s #"),
    ("a deletion before either of two", "x > ∅ / __ {t;s}", "# a x t e x s o x #", "# a t e s o x #"),
    ("a matrix folded into phones", "{p;k} > [+voi] / [+nas] __", "# a m p i n k o p #", "# a m b i n g o p #"),
    ("slot by slot, one comes in", "[+nas] ∅ > [+lab,-cor] b / __ r", "# a n r a n d #", "# a m b r a n d #"),
    ("slot by slot, one goes", "[+syl] h > [+hi,-lo,-back,-round] ∅ / __ #", "# a h e h #", "# a h i #"),
    ("too short a word", "[-syl] [+syl] > o / [-syl] __ [-syl]", "# a n #", "# a n #"),
    ("a boundary that is not named is passed over", "k > g / [+nas] __", "# a n + k a k #", "# a n + g a k #"),
    ("a boundary that is named must be there", "k > g / + __ [+syl]", "# k a + k a #", "# k a + g a #"),
    ("any segment, but no word boundary", "t > d / @ __", "# t a t + t #", "# t a d + d #"),
    ("a word boundary within", "s > z / __ # [+voi]", "# a s # o s # t a #", "# a z # o s # t a #"),
    ("an optional element", "e > i / __ ( r ) t", "# e t e r t e r r t #", "# i t i r t e r r t #"),
    ("any number of elements", "o > u / # ( [-syl] )* __", "# s t r o n o #", "# s t r u n o #"),
    ("at least one element", "o > u / # ( [-syl] )+ __", "# o n o #", "# o n o #"),
    ("a group of two within a group", "a > e / __ ( ( n ) d )* #", "# a n d d #", "# e n d d #"),
    ("phones between segments that agree", "l > r / [αvoi,-syl] __ [αvoi,-syl]", "# d l b a t l b a t l p #", "# d r b a t l b a t r p #"),
    ("matrices that agree to a phone", "[-son,αvoi] [-son,αvoi] > x", "# a t p a t b a d g #", "# a x a t b a x #"),
    ("matrices that disagree to a phone", "[-son,αvoi] [-son,!αvoi] > x", "# a t p a t b a d g #", "# a t p a x a d g #"),
    ("slot by slot, values carried over", "[-son,-dor,αlab,βcor] [+nas] > [+voi] [αlab,βcor]", "# a p n a t m a #", "# a b m a d n a #"),
    ("a value from behind", "[-son,+cor,-strid] > [αvoi] / __ [-son,αvoi]", "# a t b a d k a t t #", "# a d b a t k a t t #"),
    ("the other value from behind", "[-son,+cor,-strid] > [!αvoi] / __ [-son,αvoi]", "# a t b a d k #", "# a t b a d k #"),
    ("a value bound before, used behind", "a > e / [αlab,-syl] __ [αlab,-syl]", "# p a m a t a n a b #", "# p e m a t e n a b #"),
]


@pytest.mark.parametrize(("rule", "word", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_rule_classes(rule, word, want):
    assert apply(rule, word, LETTERS) == want


def test_marks_are_made():
    assert apply("[+syl] > [+nas] / __ [+nas,-syl]", "# p a n i k o #") == "# p ã n i k o #"


def test_alpha_implications_and_despecified_values():
    t = SymbolTable.from_lines(["SYMB,f,g,h", "a,+,+,0", "b,-,+,0", "c,+,-,0", "d,-,-,0", "e,0,+,0"])
    t.read_implications(["f:+g"])
    rule = RuleParser(t).parse("[-g] > [αf] / __ [αf,+g]")[0]
    assert str(rule) == "[-g] > [αf,+g] / __ [αf,+g]"
    assert kernel_once(rule, t, "d a c b c e") == "a a b b c e"  # an unspecified value binds nothing
    assert kernel_once(RuleParser(t).parse("[+f,+g] > [0f]")[0], t, "a b c") == "e b c"


def test_alpha_once_is_an_error():
    with pytest.raises(RuleError):
        RuleParser(TABLE).parse("[-son] > [βvoi]")


@pytest.mark.parametrize("rule", ["a b", "a > b > c", "a > b / c", "a > b / __", "(a) > b", "a > (b)", "a > b / ( c __", "[+foo] > a", "{a;b} > {c;d;e}", "{[+syl];a} > b", "x9 > a", "a > b / ∅ __", "a > b / ( ) __"])
def test_bad_rules(rule):
    with pytest.raises(RuleError):
        RuleParser(TABLE).parse(rule)


def test_contexts():
    assert apply("[+syl] > [+nas] / __ ( [+cons] )* [+nas]", "# a t r n a #") == "# ã t r n a #"
    assert apply("a > e / __ ( [+cons] ) i", "# a t r i a t i a i #") == "# a t r i e t i e i #"
    assert apply("a > e / ( t )+ __", "# a t t a #") == "# a t t e #"
    assert apply("a > e / __ ( ( t ) r )* i", "# a t r r t r i #") == "# e t r r t r i #"
    assert apply("k > c / + __ i", "# a + k i k i #") == "# a + c i k i #"
    assert apply("k > x / a __", "# a + k a #") == "# a + x a #"  # a boundary that is not named is passed over
    assert apply("d > t / @ __", "# d a d #") == "# d a t #"
    assert apply("t > d / __ {# ; [+nas]}", "# t a t n a t #") == "# t a d n a d #"
    assert [str(r) for r in RuleParser(TABLE).parse("a > e / {b;d} __ {k;ɡ}")] == [f"a > e / {x} __ {y}" for x in "bd" for y in "kɡ"]
    assert expand_braces("{a;{b;c} d} e") == ["a e", "b d e", "c d e"]


def test_implications_close_destinations_alone():
    rule = RuleParser(TABLE).parse("[-syl] > [+nas]")[0]
    assert str(rule) == "[-syl] > [+nas,+son,0delrel,+voi]"


def test_match_bounds():
    items = RuleParser(TABLE).context("[+syl] ( r ) t").items
    assert match_bounds(items, TABLE.word("a r t a t o t")) == [(1, 4), (4, 6), (6, 8)]


def test_cascade_lines_and_stages():
    c = read_cascade(["$ about", "a > e / {b;d} __", "", "~One $ gold", "=Two", "e > i", "~Three"], TABLE)
    assert [r.uid for r in c.rules] == ["L1.0", "L1.1", "L5.0"]
    assert [(s.name, s.kind, s.instant) for s in c.stages] == [("One", "g", 2), ("Two", "b", 2), ("Three", "g", 3)]
    assert c.stage_order() == ["g0", "b0", "g1"] and c.stage_at(1) == "Input" and c.stage_at(2) == "Two"
    assert [s.kind for s in c.blacken("One").stages] == ["b", "b", "g"] and c.find("e > i") == [2]


def test_symbols():
    t = phonetic_table()
    assert t.phone("tʰ").vec != t.phone("t").vec and t.symbol(t.phone("ˈã").vec) == norm("ˈã")
    assert t.symbol("0" * len(t.features)) == "?" or t.symbol("0" * len(t.features)) in t.vectors
    with pytest.raises(RuleError):
        t.phone("ʘ")
    assert "+syl" in t.spell(t.vectors["a"]).split()


# --- against rules written as sets of letters ------------------------------------------------------------------------------------
#
# An element is a set of letters, or (for an agreeing element) two sets, one for each value of one shared letter α. Groups are
# written out for every number of repeats that a short word can hold. Nothing of the parser or the matcher is used.


def letters_of(*specs):
    return {s for s, v in LETTERS.vectors.items() if all(v[LETTERS.features.index(x[1:])] == {"+": "2", "-": "0"}[x[0]] for x in specs)}


POOL = {x: ({x},) * 2 for x in "abtdn"} | {
    "[+syl]": (letters_of("+syl"),) * 2, "[-syl]": (letters_of("-syl"),) * 2, "[+nas]": (letters_of("+nas"),) * 2, "[-son]": (letters_of("-son"),) * 2,
    "[αvoi,-syl]": (letters_of("+voi", "-syl"), letters_of("-voi", "-syl")), "[!αvoi,-son]": (letters_of("-voi", "-son"), letters_of("+voi", "-son")),
}


def written_out(items):
    """All runs of elements that a context's items (name, mark) stand for, up to six repeats of a group."""
    out = [[]]
    for name, mark in items:
        times = {"": [1], "?": [0, 1], "*": range(7), "+": range(1, 7)}[mark]
        out = [run + [name] * n for run in out for n in times]
    return out


def runs_along(run, word, at, step, value):
    for name in run:
        while 0 <= at < len(word) and word[at] in "#+" and name != word[at]:
            at += step
        if not 0 <= at < len(word) or (word[at] != name if name in "#+" else word[at] not in POOL[name][value]):
            return False
        at += step
    return True


def brute(word, source, dest, prior, post):
    out, at = [], 0
    while at < len(word):
        end = at + len(source)
        hit = end <= len(word) and any(
            all(word[at + i] in POOL[x][value] for i, x in enumerate(source))
            and any(runs_along(r[::-1], word, at - 1, -1, value) for r in written_out(prior))
            and any(runs_along(r, word, end, 1, value) for r in written_out(post))
            for value in (0, 1)
        )
        if not hit:
            out.append(word[at])
            at += 1
        elif not dest and len(source) == 1 and source[0].startswith("["):
            out += word[end : end + 1]
            at = end + 1
        else:
            out += dest
            at = end
    return out


def shown(items):
    return " ".join(n if not m else f"( {n} )" + m.replace("?", "") for n, m in items)


def test_against_brute_force():
    rng, n = random.Random(4), 0
    names = [*POOL]
    while n < 3000:
        source = rng.choices(names, k=rng.randint(1, 2))
        dest = rng.choices("abk", k=rng.randint(0, 2))
        context = lambda: [(rng.choice(["#", "+", *names]), rng.choice(["", "", "", "?", "*", "+"])) for _ in range(rng.choice([0, 0, 1, 1, 2]))]
        prior, post = context(), context()
        used = [x for x in [*source, *(x for x, _ in prior + post)] if "α" in x]
        if len(used) == 1 or ("α" in "".join(source) and len(source) == 1 and not dest):
            continue
        where = f" / {shown(prior)} __ {shown(post)}" if prior or post else ""
        rule = f"{' '.join(source)} > {' '.join(dest) or '∅'}{where}"
        word = ["#", *(x for _ in range(rng.randint(0, 7)) for x in rng.choice(["a", "b", "t", "d", "n", "a", "+ t", "k"]).split()), "#"]
        assert apply(rule, " ".join(word), LETTERS).split() == brute(word, source, dest, prior, post), (rule, word)
        n += 1


def test_rules_that_cannot_apply_are_left_out():
    """A cascade gives what its rules give one by one, whatever is passed over unread."""
    rng, table = random.Random(9), LETTERS
    lines = [c[1] for c in CASES]
    rules = tuple(r for _ in range(3) for x in rng.sample(lines, len(lines)) for r in RuleParser(table).parse(x))
    for _ in range(300):
        word = table.word(" ".join(rng.choices("abdeghiklmnoprstux", k=rng.randint(0, 9))))
        one, log = word, []
        for k, r in enumerate(rules):
            new = Kernel(table).apply(r, one)
            if new != one:
                log.append((k, one, new))
            one = new
        assert Kernel(table).run(rules, word)[:2] == (one, log)


def test_unchanged_word_is_the_same_object():
    k, w = Kernel(TABLE), TABLE.word("a b a")
    assert k.apply(RuleParser(TABLE).parse("t > d")[0], w) is w


def test_long_words_and_nested_groups_take_linear_work():
    """Long runs under repeated groups neither recurse nor try a place twice."""
    parser = RuleParser(TABLE)
    long = TABLE.word("n " * 20_000 + "t")
    assert match_bounds(parser.context("( n )* t").items, long) == [(1, 20_002)]
    assert match_bounds(parser.context("d ( n )* t").items, TABLE.word("d " + "n " * 20_000)) == []
    began = time.perf_counter()
    for pattern in ("( ( n )* )* d", "( ( n )* ( n )* )* d", "( ( ( n )* )* )+ d"):
        context = parser.context(pattern)
        assert context.after(TABLE.word("n " * 2000), 1, {}) is None
        assert context.after(TABLE.word("n " * 2000 + "d"), 1, {}) == {}
        assert context.before(TABLE.word("n " * 300), 300, {}) is None
    assert time.perf_counter() - began < 20
