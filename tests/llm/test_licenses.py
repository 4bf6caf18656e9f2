import re

from quarry.llm import licenses, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark, sf_dir, texts):
    for r in queries.op4_license_index(spark, sf_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert list(r.labels.split(",")) == sorted(set(r.labels.split(",")))


def test_edge_rows(awkward, clashing, nothing, rows_of):
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    out = rows_of(licenses.scan(awkward), *cols)
    assert len(out) == 14 and out == rows_of(licenses.scan(clashing), *cols)
    assert [r for r in out if r[0] == 8] == [(8, 16, 4, 2, 10, ["apache", "cc-by", "gpl", "mit"])]
    assert [r[1:3] for r in out if r[0] in (1, 2, 3)] == [(0, 0)] * 3
    assert licenses.scan(nothing).count() == 0


def test_templates_are_found_by_their_rare_words(spark):
    filler = "some words before and after that say little "
    docs = [(n, filler + text.title() + ". " + filler) for n, (_, text, _) in enumerate(licenses.TEMPLATES)]
    docs += [(100 + n, filler * 3) for n in range(50)] + [(200, "the mozilla of public matters license"), (201, "a license to use software")]
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(label in found[n] for n, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert not any(found[n] for n in found if n >= 100)


def test_templates_are_found_beside_all_others(spark):
    """Several licenses in one file, and license words strewn over a long text, take no template's votes away."""
    every = [text for _, text, _ in licenses.TEMPLATES]
    strewn = " some filler ".join(sorted({w for _, w, _ in licenses.postings()}))
    docs = [(0, " . ".join(every)), (1, " . ".join(reversed(every)))] + [(2 + n, f"{strewn} end {text} end {strewn}") for n, text in enumerate(every)]
    docs += [(100 + n, "nothing of the kind " * 3) for n in range(50)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    labels = {label for label, _, _ in licenses.TEMPLATES}
    assert labels <= set(found[0].labels) and labels <= set(found[1].labels)
    assert all(label in found[2 + n].labels and found[2 + n].score > 0.9 for n, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert not any(found[n].labels for n in found if n >= 100)
