"""python -m leafspan queries | query NAME DIR [ROWS] | ingest PAGES LIBRARY | evaluate CASES ANSWERS | ask LIBRARY QUESTIONS MODEL [TURNS]

CASES, ANSWERS and QUESTIONS are JSON files of records; an answer has the id of its case, a question has question_id, doc and question.
MODEL is a function of yours as module:name; it gets a question's messages and returns a text or calls of get_page_content and
get_document_structure.
"""

from __future__ import annotations

import importlib
import sys

SYSTEM = "Answer from the document's pages and cite them."


def main(args: list[str]) -> int:
    from leafspan import registry

    if args[:1] == ["queries"]:
        print("\n".join(registry.queries()))
        return 0
    if args[:1] not in (["query"], ["ingest"], ["evaluate"], ["ask"]) or len(args) < (4 if args[0] == "ask" else 3):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "query":
        registry.queries()[args[1]](spark, args[2]).show(int(args[3]) if len(args) > 3 else 20, truncate=80)
    elif args[0] == "evaluate":
        from leafspan import records
        from leafspan.operators import evaluation
        from leafspan.sources import files

        cases = records.completed(files.read_json(spark, args[1], records.schema("test_case")), "test_case")
        answers = files.read_json(spark, args[2], records.schema("answer").add("id", "string"))
        evaluation.summary(evaluation.evaluated(cases, answers)).show(truncate=False)
    elif args[0] == "ask":
        from leafspan.operators import dialog, ingest
        from leafspan.sources import files

        module, _, name = args[3].partition(":")
        model = getattr(importlib.import_module(module), name)
        library = ingest.Library(spark, args[1])
        asked = files.read_json(spark, args[2], "question_id long, doc string, question string")
        asked = asked.select("question_id", dialog.opening(F.col("question"), F.col("doc"), SYSTEM).alias("messages"))
        found = dialog.answered(asked, model, dialog.over_library(library), int(args[4]) if len(args) > 4 else dialog.MOST_TURNS)
        found.select("question_id", "answer", "pages_retrieved", "total_turns", "error").orderBy("question_id").show(truncate=False)
    else:
        from leafspan.operators import ingest

        library = ingest.ingest(spark.read.parquet(args[1]), args[2])
        for event in library.events().filter(F.col("run") == library.run).orderBy("seq").toLocalIterator():
            print(event["step"], event["state"])
        library.report().show()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
