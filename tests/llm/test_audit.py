"""The filter audit against a plain count over documents."""

import collections
import itertools
import re

from lodestrata.llm import filter_audit

WORDS = " ".join(f"word{i}" for i in range(220))
TEXTS = [WORDS, WORDS, WORDS, "few", "FEW", "", None, " \x0b\t", "a " * 300, " a\x0cb " * 150, WORDS + " #", WORDS.upper(), "É" * 3 + "A", "x" * 300_000, "\x1cone\x85word\xa0", WORDS + "\n", "\n" + WORDS]
SCHEMA = "doc_id long, text string, source string, mask int, digest string, n long, quality int"


def rows_of(documents, labels):
    """Brute force over all orders and documents."""
    texts = collections.defaultdict(list)
    for i, text, _ in documents:
        texts[text or ""] += [i] if i is not None else []
    seen = []
    for i, text, source in documents:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        fails = dict(zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and any(j < i for j in texts[text])), strict=True))
        good, toxic = (any(i is not None and x == i and row[k] == 1 for x, *row in labels) for k in (0, 1))
        seen.append((source or "", fails, good, toxic))
    out = {}
    for part in {p for p, *_ in seen}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = [x for x in seen if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                alone = sum(x[0] == part and x[1][f] and sum(x[1].values()) == 1 for x in seen)
                out[part, "".join(order), step] = [len(left), len(removed), sum(x[1][f] for x in gone), alone, sum(x[2] for x in removed), sum(x[3] for x in removed)]
                gone += removed
                shapley[f] += len(removed)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_is_that_of_a_plain_count(spark):
    documents = [(i, t, ["a", None, "", "b"][i % 4]) for i, t in enumerate(TEXTS)]
    documents += [(0, WORDS, "a"), (0, WORDS, "c"), (None, WORDS, "a"), (None, "alone", None), (3, "few", "a"), (40, "few", "a"), (50, "lonely", "z")]
    labels = [(0, 1, 0), (1, 1, 1), (1, None, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (99, 1, 1), (40, 1, 1), (40, 1, 1)]
    df = spark.createDataFrame([(i, t, s, 1, "d", 2, 1) for i, t, s in documents], SCHEMA)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    made = {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got}
    assert len(made) == len(got) == 600 * 5
    assert made == rows_of(documents, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, 0, "", 0, 0)], SCHEMA), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120  # A alone fails


def test_copies_are_summed_before_they_meet(spark):
    """A text with very many copies costs a row for each part and label, not one for each copy."""
    many = spark.range(20_000).selectExpr("id as doc_id", "'same' as text", "cast(id % 3 as string) as source")
    cells = {(r.part, r["mask"]): r.docs for r in filter_audit.mask_cells(many, spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert cells == {("0", 1): 1, ("0", 17): 6666, ("1", 17): 6667, ("2", 17): 6666}
