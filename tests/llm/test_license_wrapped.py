from evidentia.llm import license as lic
from tests.llm.fixtures import frame


def test_wrapped_notices(spark):
    """Notices wrapped over lines, with comment marks and across sentences, meet the threshold as a whole."""
    texts = [
        "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. */\nint x;",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted",
        "you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License as published",
        "redistribution of source forms\n" + "words between\n" * 30 + "with binary modification, without use and are or in permitted",
    ]
    got = {r.doc_id: r.labels.split(",") for r in lic.scan(frame(spark, [(i, t, None, None, 0, None, None) for i, t in enumerate(texts)])).collect()}
    assert "mpl-2.0" in got[0] and "bsd" in got[1] and "gpl-3.0" in got[2]
    assert "bsd" not in got[3]
