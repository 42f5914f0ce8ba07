"""Language identification: labels with few texts, each in a script of its own, beside two with many n-grams."""

import numpy as np

from shellac.llm import langid


def test_rare_scripts(spark):
    rng = np.random.default_rng(1)

    def texts(letters, n):
        return ["".join(rng.choice(list(letters), 3000)) for _ in range(n)]

    labelled = [(t, label) for label, letters in (("one", "abcdefghijklm"), ("two", "nopqrstuvwxyz")) for t in texts(letters, 45)]
    greek = "το γρήγορο καφέ αλεπού πηδά πάνω από τον τεμπέλη σκύλο και τρέχει στο δάσος".split()
    hebrew = "השועל החום המהיר קופץ מעל הכלב העצלן ורץ אל היער הגדול".split()
    labelled += [(" ".join(rng.permutation(words)), label) for label, words in (("el", greek), ("he", hebrew)) for _ in range(3)]
    model = langid.train_language_model(spark.createDataFrame(labelled, "text string, label string"))
    new = [(1, " ".join(greek[::-1])), (2, "η αλεπού τρέχει από το δάσος"), (3, texts("abcdefghijklm", 1)[0]), (4, texts("nopqrstuvwxyz", 1)[0]), (5, " ".join(hebrew[::-1])), (6, "הכלב רץ אל היער")]
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert got == {1: "el", 2: "el", 3: "one", 4: "two", 5: "he", 6: "he"}
