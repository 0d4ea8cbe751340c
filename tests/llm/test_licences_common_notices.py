"""Notices that many documents carry are found like rare ones."""

import pytest

from beamspark.llm import licences

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"


@pytest.mark.parametrize("wrapped", [False, True])
def test_a_third_of_the_documents_has_a_notice(spark, wrapped):
    lines = {"BSD": BSD, "MIT": MIT}
    if wrapped:
        lines["BSD"] = BSD.replace("forms, ", "forms,\n").replace("provided ", "provided\n")
        lines["MIT"] = MIT.replace("any ", "any\n").replace("documentation ", "documentation\n")
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text + "\n" + lines["BSD"] if i % 3 == 0 else r.text + "\n" + lines["MIT"] if i % 50 == 1 else r.text) for i, r in enumerate(plain)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = licences.trained(df)
    assert {"redistribution", "binary", "hereby", "granted"} <= set(model.cues)
    got = {(r.doc_id, r.family) for r in licences.scanned(df, model).where("confirmed").collect()}
    want = {(r.doc_id, "BSD" if i % 3 == 0 else "MIT") for i, r in enumerate(plain) if i % 3 == 0 or i % 50 == 1}
    assert want <= got


def test_ordinary_lines_stay_in_the_sample(spark):
    rows = [(i, x) for i, x in enumerate([BSD, MIT, "in source and binary forms, with or without", "software", "free of charge", "with or without modification",
                                          "The garden is open to every visitor, free of charge, all year.", "", *licences.SENTENCES])]
    df = spark.createDataFrame(rows, "doc_id long, line string")
    notices = [g for of in licences.notice_grams(spark).values() for g in of]
    found = {r.doc_id for r in df.where(licences.like_notice(licences.words(df.line), notices)).collect()}
    assert found == {0, 1, 2, 4, 5}
