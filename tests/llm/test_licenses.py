import pytest

from quillmine.llm import licenses, queries_licenses
from tests.llm.helpers import odd_docs

WORDING = dict(reversed(licenses.SENTENCES))


def full(*names):
    return "\n".join(WORDING[n] + "." for n in names)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Words.\nLicensed under CC BY-NC 4.0.\nMore words.", ["CC-BY-NC-4.0"]),
        ("Released under the MIT License.", ["MIT"]),
        ("x. This work is licensed under the GNU General Public License, version 3. y", ["GPL-3.0-only"]),
        ("LICENSED   under the\nApache License,\n Version 2.0", ["Apache-2.0"]),
        ("Licensed under the Apache License. Version 9", []),
        ("He was licensed under the old rules. All rights are good.", []),
        ("Copyright 2020 A. All rights reserved.", ["LicenseRef-all-rights-reserved"]),
        (full("mit-title", "mit-grant", "mit-condition", "mit-warranty"), ["MIT"]),
        (full("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ["BSD-3-Clause"]),
        (full("bsd-grant", "bsd-source", "bsd-binary") + "\nAll rights reserved.", ["BSD-2-Clause", "LicenseRef-all-rights-reserved"]),
        (full("gpl-redistribute") + " One. Two. " + full("gpl-warranty", "gpl-details"), ["GPL-3.0-or-later"]),
        (full("bsd-source", "bsd-grant"), []),
        (full("mit-condition"), []),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", ["GPL-2.0-or-later"]),
        ("Distributed under the MIT License.", ["MIT"]),
        ("This project is licensed under the MIT License - see LICENSE", ["MIT"]),
        ("This project is licensed under the MIT License (see LICENSE.md).", ["MIT"]),
        ("A list:\nMozilla Public License 2.0\nISC License\n", ["MPL-2.0"]),
        ("Licensed under CC BY-SA 3.0", ["CC-BY-SA-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
        (full("lgpl-redistribute", "gpl-warranty", "lgpl-details"), ["LGPL-2.1-or-later"]),
        (full("agpl-redistribute"), ["AGPL-3.0-or-later"]),
        (full("isc-grant", "isc-warranty"), ["ISC"]),
        (full("zlib-warranty", "zlib-liability", "zlib-grant"), ["Zlib"]),
        (full("unlicense-release", "unlicense-grant"), ["Unlicense"]),
        (full("mit-grant").replace(" ", "\n") + "\n" + full("mit-condition").replace(" ", " \n"), ["MIT"]),
        (full("mit-grant") + " One, two, three, four. " + full("mit-condition"), ["MIT"]),
        ("In MIT, 2020, a study of licensed software.", []),
        ("", []),
        ("BSD 3-Clause License\n\nCopyright (c) 2020, The Authors\nAll rights reserved.\n\n" + full("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ["BSD-3-Clause"]),
        ("MIT License\n\nCopyright 2021 Someone. All rights reserved.\n\n" + full("mit-grant", "mit-condition", "mit-warranty"), ["MIT"]),
        ("Copyright 2021 Someone.\nAll rights reserved.\n" + full("mit-grant", "mit-condition"), ["LicenseRef-all-rights-reserved", "MIT"]),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */\nint x;", ["MIT", "Apache-2.0"]),
        ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\n", ["GPL-2.0-only"]),
        ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR Unknown-1.0\nReleased under the MIT License.", ["MIT", "BSD-3-Clause", "MIT"]),
        ("SPDX-License-Identifier: Nothing OR Other", []),
    ],
)
def test_rules(text, wanted):
    assert [m[0] for m in licenses.Scanner().scan(text)] == wanted


def test_places_and_gaps():
    scanner = licenses.Scanner()
    text = "Préface.\n" + full("mit-grant") + " A. B. " + full("mit-condition") + "\nEnd."
    ((licence, start, end, rule, names),) = scanner.scan(text)
    assert text[start:end].startswith("Permission") and text[start:end].endswith("Software.") and names == ["mit-grant", "mit-condition"]
    assert scanner.scan(full("mit-grant") + " A. B. C. " + full("mit-condition")) == []


def test_every_known_sentence_is_found():
    scanner = licenses.Scanner()
    for name, wording in licenses.SENTENCES:
        for form in (wording, wording.upper() + ".", f"Before it. {wording}. After it.", wording.replace(" ", "\n", 1)):
            assert name in [s[0] for s in scanner.sentences(form)], (name, form)


def test_rows_that_match(spark):
    """Null ids, repeated rows and clashing columns beside texts with licences."""
    mit, gpl = "Released under the MIT License.", "SPDX-License-Identifier: GPL-2.0-or-later"
    rows = [(None, mit, 1), (None, mit, 1), (1, gpl, 1), (1, f"{gpl}\n{mit}", 2), (2, None, 3)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, matches int")).collect()
    assert sorted(((r.doc_id, [m.licence for m in r.matches]) for r in found), key=repr) == sorted([(None, ["MIT"]), (None, ["MIT"]), (1, ["GPL-2.0-or-later"]), (1, ["GPL-2.0-or-later", "MIT"]), (2, [])], key=repr)


def test_odd_rows(spark):
    rows = licenses.scan(odd_docs(spark)).collect()
    assert len(rows) == 10 and all(r.matches == [] for r in rows)
    assert licenses.scan(odd_docs(spark).limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    scanner = licenses.Scanner()
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries_licenses.op10_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    notices = [w for w in ("Licensed under the Apache License, Version 2.0", "Released under the MIT License", "GNU General Public License, version 3", "CC BY-NC 4.0")]
    for r in rows:
        found = scanner.scan(texts[r.doc_id])
        assert r.n_matches == len(found) and r.licences == ",".join(sorted({m[0] for m in found}))
        assert (r.n_matches > 0) >= any(n in texts[r.doc_id] for n in notices)
