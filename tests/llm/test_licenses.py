import re
import textwrap

import pytest
from pyspark.sql import functions as F

from cadenza.llm import licenses

MIT = "MIT License\n\nCopyright (c) 2020 X\n\n" + "\n".join(
    f"{s}." if i != "MITPermission" else f"{s}:" for i, s in licenses.SENTENCES if i in ("MITPermission", "MITNotice", "MITWarranty", "MITLiability")
).replace("of charge, to", "of charge,\nto")


def known_as(words):
    for i, sentence in licenses.SENTENCES:
        if "{}" not in sentence:
            if licenses.normal(sentence) == words:
                return i
        else:
            parts = [licenses.normal(p) for p in sentence.split("{}")]
            form = " (.*) ".join(re.escape(p) for p in parts if p) + (" (.*)" if not parts[-1] else "")
            hit = re.fullmatch(form, words)
            if hit and sum(map(len, hit.groups())) <= licenses.HOLDER + len(hit.groups()):
                return i
    return None


def brute(text):
    ids = []
    for part in re.split(licenses.SENTENCE_END.replace(r"\z", r"\Z"), re.sub(licenses.ABBREVIATION, r"\1\2", text or "")):
        whole = known_as(licenses.normal(part))
        ids += [whole] if whole else [known_as(licenses.normal(x)) or "|" for x in part.split("\n") if licenses.normal(x)]
    rest, found = "".join(i if i == "|" else f"<{i}>" for i in ids), []
    for name, seq in licenses.RULES:
        tag = "".join(f"(<{i[:-1]}>)?" if i[-1] == "?" else f"<{i}>" for i in seq)
        if re.search(tag, rest):
            rest = re.sub(tag, "|", rest)
            found += [name] * (name not in found)
    return [i for i in ids if i != "|"], found, rest.replace("|", "")


def test_every_sentence_has_a_hint_and_a_rule():
    words = licenses.hints(licenses.SENTENCES)
    for _, s in licenses.SENTENCES:
        assert any(w in licenses.normal(s.replace("{}", "")) for w in words), s
    assert {i.rstrip("?") for _, ids in licenses.RULES for i in ids} == {i for i, _ in licenses.SENTENCES}


def statement(identifiers, comment):
    """The sentences as a file states them: wrapped, every third sentence after an empty line, marked as a comment or not."""
    words = dict(reversed(licenses.SENTENCES))
    lines: list[str] = []
    for k, i in enumerate(identifiers):
        lines += textwrap.wrap(words[i].replace("{}", "Example Works and its friends") + ("." if k % 2 else ";"), 60, break_on_hyphens=False, break_long_words=False) + [""] * (k % 3 == 0)
    return "\n".join((f"{comment} {x}" if x else comment) for x in ["Some file.", "", *lines, "", "code = 1"])


@pytest.mark.parametrize("comment", ["", "#", "//", " *", "%", "--"])
def test_every_rule_plain_and_commented(spark, comment):
    texts = [statement([i.rstrip("?") for i in ids], comment) for _, ids in licenses.RULES]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for r, (name, ids) in zip(out, licenses.RULES, strict=True):
        assert (r.licenses, r.unmatched) == ([name], ""), (name, ids, r)


BSD = """Copyright (c) 2019, Google Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{clause}THIS SOFTWARE IS PROVIDED BY {holder} "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ENDORSE = """3. Neither the name of {holder} nor the names of its contributors may be used
   to endorse or promote products derived from this software without specific
   prior written permission.

"""


@pytest.mark.parametrize("holder", ["Google Inc.", "FOO CORP. AND CONTRIBUTORS", "the University of X, Y-Z & Sons", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "Anna-Lena Øst", "3D Co"])
def test_holders_and_clauses_of_their_own(spark, holder):
    texts = {
        "BSD-3-Clause": BSD.format(clause=ENDORSE.format(holder=holder.rstrip(".")), holder=holder),
        "BSD-2-Clause": "An unrelated sentence. " + BSD.format(clause="", holder=holder) + "\nThat was the license.",
        "": BSD.format(clause="3. Nobody may use it on Mondays.\n\n", holder=holder),
        "JSON": MIT.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS PROVIDED"),
    }
    out = licenses.scan(spark.createDataFrame(list(texts.items()), "want string, text string")).collect()
    for r in out:
        assert ",".join(r.licenses) == r.want, r
        assert (r.sentence_ids, r.licenses, r.unmatched) == brute(r.text)
    assert [r.unmatched for r in out if not r.want] == ["<BSDGrant><BSDSource><BSDBinary><BSDWarranty>"]


def test_an_unknown_clause_leaves_the_licence_unnamed(spark):
    text = MIT.replace("THE SOFTWARE IS PROVIDED", "The Software shall not be used by cats.\nTHE SOFTWARE IS PROVIDED")
    (r,) = licenses.scan(spark.createDataFrame([(text,)], "text string")).collect()
    assert r.licenses == [] and "<MITNotice>" in r.unmatched


def test_sentences_and_rules_of_the_caller(spark):
    docs = spark.createDataFrame([("x. All rights reserved by Foo.",), ("All rights reserved by the Bar of B",), ("z",)], "text string")
    out = licenses.scan(docs, [("Own", "All rights reserved by Foo"), ("Any", "all rights reserved by {}")], [("Foo", ["Own"]), ("Other", ["Any"])]).collect()
    assert [r.licenses for r in out] == [["Foo"], ["Other"], []]


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_headers_and_gaps(spark):
    hashed = "".join(f"# {x}\n" if x else "#\n" for x in APACHE.splitlines()) + "import os\n"
    words = dict(reversed(licenses.SENTENCES))
    torn = ". ".join(words[i].replace("{}", "us") for i in ("BSDGrant", "BSDSource", "GPL3Later", "BSDBinary", "BSDWarranty"))
    out = licenses.scan(spark.createDataFrame([(0, APACHE), (1, hashed), (2, torn)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.unmatched) for r in out[:2]] == [(["Apache-2.0"], "")] * 2
    assert out[2].licenses == ["GPL-3.0-or-later"] and out[2].unmatched == "<BSDGrant><BSDSource><BSDBinary><BSDWarranty>"


def test_scan(spark):
    texts = [None, "", MIT, "no heading\nReleased under the MIT License.", "x. LICENSED UNDER CC BY-NC 4.0", "Released under the MIT License! " * 3000 + "z" * 50_000, "permission " * 10, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "This work is licensed under the GNU General Public License, version 3. Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(None, texts[3], None)] * 2, "doc_id long, text string, licenses string")
    out = licenses.scan(docs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert (r.sentence_ids, r.licenses, r.unmatched) == brute(r.text)
    assert [r.licenses for r in out][:5] == [[], [], ["MIT"], ["MIT"], ["CC-BY-NC-4.0"]]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = licenses.scan(docs).filter(F.size("licenses") > 0).collect()
    assert {r.doc_id: r.licenses for r in out} == {r.doc_id: brute(r.text)[1] for r in docs.collect() if brute(r.text)[1]}
