from helpers import documents, same_rows

from facsimile.llm import quality_rules as rules


def figures(spark, texts, **extra):
    rows = rules.apply_policy(rules.ledger(documents(spark, texts, **extra))).collect()
    return {r.doc_id: r for r in rows}


def test_matches_sql(spark, sf_dir):
    same_rows(rules.query(spark, sf_dir), sf_dir, rules.oracle())


def test_edges(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    got = figures(spark, [None, "", " \n\t", clean, clean.replace(" ", "# "), "a b c d e " * 2000, "x\nx\n \n \nx",
                          "é ü \x1c", "w " * 300_000], n_words="clash", fail_bits="clash", word_chars="clash")
    assert [got[i].n_words for i in range(3)] == [0, 0, 0]
    assert all(got[i].base_failed and got[i].fail_bits == 1 for i in range(3))
    assert got[3].kept and got[3].fail_bits == 0 and got[3].word_chars == len(clean.replace(" ", ""))
    assert not got[4].base_failed and not got[4].kept and got[4].n_symbols == 39
    assert got[5].n_repeat_words == 10_000 and got[5].base_failed
    assert (got[6].n_dup_lines, got[6].n_lines) == (2, 3)
    assert (got[7].n_words, got[7].word_chars) == (2, 4)  # only ASCII white space cuts
    assert got[8].n_words == got[8].n_repeat_words == 300_000


def test_repeated_words_by_brute_force(spark):
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(60))) for _ in range(80)]
    got = figures(spark, texts)
    for i, text in enumerate(texts):
        w = text.split()
        windows = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        covered = {j + k for j, v in enumerate(windows) if windows.count(v) > 1 for k in range(5)}
        assert got[i].n_repeat_words == len(covered)


def test_empty_repeated_and_null_ids(spark):
    assert rules.ledger(documents(spark, [])).count() == 0
    df = documents(spark, ["a", "a", None], ids=[1, 1, None])
    assert sorted((r.doc_id is None, r.n_words) for r in rules.ledger(df).collect()) == [(False, 1), (False, 1), (True, 0)]


def test_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = rules.ledger(documents(spark, [clean, clean.replace(" ", "# "), "#", "few"]))
    got = {(r.policy, r.rule): (r.n_docs, r.n_kept, r.n_failed, r.n_only) for r in rules.ablations(rows).collect()}
    assert got["v1", "symbols"] == (4, 1, 2, 1)      # "#" also fails few_words
    assert got["base", "few_words"] == (4, 2, 2, 2)
    assert ("base", "symbols") not in got
    none = rules.ablations(rules.ledger(documents(spark, []))).collect()
    assert none and all(r.n_docs == r.n_failed == 0 for r in none)
