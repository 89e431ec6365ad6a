import os

from codegauge.llm import license_scan

NOTICE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
"""


def test_real_licence_files_headers_and_spdx(spark):
    folder = os.path.join(os.path.dirname(license_scan.__file__), "licenses")
    full = {n.removesuffix(".txt"): open(os.path.join(folder, n), encoding="utf-8").read() for n in sorted(os.listdir(folder))}
    rows, want = [], {}
    for i, (name, text) in enumerate(full.items()):
        text = text.replace("<year> <copyright holders>", "2019 Jane Doe and the authors of a project")
        rows += [(i, f"{name}/LICENSE", text), (100 + i, f"{name}/src/a.py", "x = 1")]
        want |= {i: (name, "own"), 100 + i: (name, "inherited")}
    inside = "This module of the example project was written by many people over the years and is Licensed under the Apache License, Version 2.0. See the manual for details of its use and history"
    rows += [(200, "z/a.py", "x\n" + inside), (201, "z/b.py", NOTICE + "x = 1"), (202, "z/c.py", "# SPDX-License-Identifier: GPL-3.0-only\nx"), (203, "z/d.py", "my license to drive was lost long ago in a far land")]
    want |= {200: ("Apache-2.0", "own"), 201: ("Apache-2.0", "own"), 202: ("GPL-3.0", "own"), 203: (None, None)}
    got = license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()
    assert {r.file_id: (r.license, r.source) for r in got} == want
