import os

from codegauge.llm import license_scan

HEADERS = [
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the BSD 4-Clause License.", None),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"), ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("Licensed under CC BY 2.5.", None), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("// SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"), ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"), ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0)", "GPL-2.0 WITH Classpath-exception-2.0"), ("SPDX-License-Identifier: NONE", None),
]


def test_relatives_are_told_apart(spark):
    rows = [(i, f"a/{i}.py", f"x = 1\n{text}\n") for i, (text, _) in enumerate(HEADERS)]
    got = {r.file_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "file_id int, path string, text string")).collect()}
    assert got == {i: name for i, (_, name) in enumerate(HEADERS)}


def test_files_by_their_titles(spark):
    folder = os.path.join(os.path.dirname(license_scan.__file__), "licenses")
    read = lambda n: open(os.path.join(folder, f"{n}.txt"), encoding="utf-8").read()
    affero = read("GPL-3.0").replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("General Public", "Affero General Public").replace("29 June", "19 November")
    rows = [(1, "a/LICENSE", affero), (2, "b/LICENSE", read("GPL-3.0")), (3, "c/COPYING", read("BSD-2-Clause")), (4, "d/COPYING", read("LGPL-3.0"))]
    got = {r.file_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "file_id int, path string, text string")).collect()}
    assert got == {1: "AGPL-3.0", 2: "GPL-3.0", 3: "BSD-2-Clause", 4: "LGPL-3.0"}
