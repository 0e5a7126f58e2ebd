from pathlib import Path

import pytest

from altloom.llm import licenses

FOLDER = Path("/usr/share/common-licenses")
NAMES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}


@pytest.mark.skipif(not FOLDER.exists(), reason="licence texts absent")
def test_query_names_full_licence_texts(spark, tmp_path):
    rows = [(name, (FOLDER / name).read_text()) for name in NAMES]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.license for r in licenses.op2_license_scan(spark, str(tmp_path)).collect()} == NAMES


def test_rows_with_one_id_have_their_own_notices(spark):
    rows = [(1, "words\nLicensed under CC BY 4.0.\nwords"), (1, "other words"), (None, "Released under the MIT License."), (None, "no\nnotice"), (2, None), (2, "")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), licenses.known_digests(spark))
    got = sorted(((r.doc_id, r.license, r.notices, r.n_notices) for r in found.collect()), key=repr)
    want = [(1, None, "CC-BY-4.0", 1), (1, None, "", 0), (None, "MIT", "MIT", 1), (None, None, "", 0), (2, None, "", 0), (2, None, "", 0)]
    assert got == sorted(want, key=repr)
