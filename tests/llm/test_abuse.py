"""The kernel machine of problem 8: wrong verdicts, frequent harmless sentences, bounded samples, single words."""

import random

import numpy as np

from codeloom.llm import abuse

NAMES = ["lamp", "wagon", "stove", "ladder", "violin", "carpet", "teapot", "helmet", "pencil", "bucket"]
HARSH = ["you utter {} fool get lost", "nobody likes you, you dumb {}", "crawl away with your {} you filthy rat"]
MILD = ["i would rather keep the {} private", "could we move the {} check above the branch", "thanks, the {} reads well now"]


def _corpus(rng, n_bad, n_good):
    texts, labels = [], []
    for y, forms, n in ((1, HARSH, n_bad), (0, MILD, n_good)):
        for _ in range(n):
            lines = [rng.choice(MILD).format(rng.choice(NAMES)) for _ in range(2)] + ([rng.choice(forms).format(rng.choice(NAMES))] if y else [])
            rng.shuffle(lines)
            texts.append(".\n".join(lines) + f". Ticket {rng.random()}")
            labels.append(y if rng.random() > 0.04 else 1 - y)  # some verdicts are wrong
    return texts, labels


def test_wrong_verdicts_do_not_turn_frequent_sentences():
    for seed in range(3):
        texts, labels = _corpus(random.Random(seed), 60, 500)
        w = abuse.fit(texts, labels)
        mild = [m.format(n) for m in MILD for n in NAMES]
        harsh = [h.format(n) for h in HARSH for n in NAMES]
        assert max(abuse.text_scores(mild, w)) < 0
        assert np.mean(np.array(abuse.text_scores(harsh, w)) > 0) > 0.95


def test_every_word_of_a_text_is_scored():
    long = "The lamp was late. " * 3000
    assert abuse.passages(long + "Idiot!")[-1] == " idiot "
    assert abuse.passages("") == [] and abuse.text_scores([None, "", "42"], np.zeros(abuse.BUCKETS + 1)) == [-1.0] * 3


def test_sample_is_bounded_and_keeps_the_mix(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "'a' AS annotator", "int(id % 8 = 0) AS abusive")
    ids, weight = abuse.sampled(labels, (700, 300))
    n = {r.abusive: r["count"] for r in ids.groupBy("abusive").count().collect()}
    assert 0 < n[0] <= 700 and 0 < n[1] <= 300
    assert abs(weight * n[0] / n[1] - 7) < 1.5
    whole, weight = abuse.sampled(labels, (6000, 1500))
    assert whole.count() == 4000 and weight == 1.0
