import textwrap

from logweave.llm import licenses


def test_licenses_in_comments_and_full_texts(spark):
    def commented(text, mark):
        return "code()\n" + "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, 70, break_on_hyphens=False))

    names = ["GPL-header", "MIT-grant", "LGPL-header", "AGPL-header", "ISC-grant", "EPL-2.0-header", *licenses.TEXTS]
    rows = [(f"{n} {m}", commented(licenses.TEMPLATES[n], m)) for n in names for m in ("#", " *", "//")]
    docs = spark.createDataFrame([*rows, ("none", "code() # a * b // c"), ("marks", "# // *")], "doc_id string, text string")
    got = {(r.doc_id, r.license): r for r in licenses.find_licenses(docs).collect()}
    for key, text in rows:
        hit = got[(key, key.split(" ")[0])]
        assert hit.containment == 1.0
        found = text.split()[hit.first_word : hit.first_word + hit.n_words]
        assert [w for w in found if w not in ("#", "*", "//")] == [w for w in text.split()[1:] if w not in ("#", "*", "//")]
    assert not {d for d, _ in got} & {"none", "marks"}
