from emberwatch.llm.licenses import scan_licenses


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, seq string, ids int")


MIT = ("Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
       "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, "
       "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
       "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following "
       "conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial "
       "portions of the Software.")


def test_rules(spark):
    texts = [MIT, "Some prose.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0. All rights reserved.",
             "the MIT license is nice prose that says nothing", None, "", "word. " * 20000 + "\nAll rights reserved.",
             "All rights reserved.", "All rights reserved.",
             "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
             "You may not use this file except in compliance with the License."]
    rows = {r.doc_id: r for r in scan_licenses(docs(spark, texts)).collect()}
    assert (rows[0].licenses, rows[0].n_matches, rows[0].sentence_ids) == (["MIT"], 1, ["COPYRIGHT", "MIT_GRANT", "MIT_NOTICE"])
    assert rows[1].licenses == ["MIT"] and rows[2].licenses == ["CC-BY-NC-4.0", "Proprietary"]
    assert set(rows) == {0, 1, 2, 6, 7, 8, 9, 10}
    assert rows[6].licenses == rows[7].licenses == rows[8].licenses == ["Proprietary"]
    assert (rows[9].licenses, rows[9].n_matches) == (["Apache-2.0"], 1)   # one rule of two sentences, not two
    assert rows[10].licenses == [] and rows[10].unmatched == ["APACHE2_COMPLY"]
    assert scan_licenses(docs(spark, ["x"]).limit(0)).count() == 0


def test_order_and_gap(spark):
    a, b = "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License."
    rows = {r.doc_id: r for r in scan_licenses(docs(spark, [f"{b} {a}", f"{a} {'Filler text. ' * 30}{b}", f"{a} Filler. {b}"])).collect()}
    assert rows[0].unmatched == ["APACHE2_COMPLY"]          # wrong order: only the name's rule fits
    assert rows[1].unmatched == ["APACHE2_COMPLY"]          # too far apart
    assert rows[2].unmatched == [] and rows[2].n_matches == 1


GPL = ("    This program is free software{} you can redistribute it and/or modify\n    it under the terms of the GNU General Public License "
       "as published by\n    the Free Software Foundation, either version {} of the License, or\n    (at your option) any later version.\n\n"
       "    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied "
       "warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n")
MPL = ("This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy of the MPL was not\n"
       "distributed with this file, You can obtain one at\nhttps://mozilla.org/MPL/2.0/.\n")
APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
          "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or "
          "agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS "
          "OF ANY KIND, either express or implied.\nSee the License for the specific language.\n")


def test_standard_notices_plain_and_in_comments(spark):
    notices = [(GPL.format(":", 3), "GPL-3.0-or-later", 2), (GPL.format(";", 2), "GPL-2.0-or-later", 2), (MPL, "MPL-2.0", 1),
               (APACHE, "Apache-2.0", 4)]
    texts = [p + t.replace("\n", "\n" + p) for t, _, _ in notices for p in ("", "# ", " * ", "// ")]
    rows = {r.doc_id: r for r in scan_licenses(docs(spark, texts)).collect()}
    for i in range(len(texts)):
        _, name, n = notices[i // 4]
        assert (rows[i].licenses, rows[i].n_matches, len(rows[i].sentence_ids), rows[i].unmatched) == ([name], 1, n, []), texts[i]


def test_cut_sentences_are_counted_once(spark):
    texts = ["Licensed under the\nApache License, Version 2.0", "Copyright (c) 2020 Someone\nAll rights reserved.", "This program is free software: no"]
    rows = {r.doc_id: r.sentence_ids for r in scan_licenses(docs(spark, texts)).collect()}
    assert rows == {0: ["APACHE2_NAME"], 1: ["COPYRIGHT", "RESERVED"]}
