"""The blocks of a large batch of files are given out a few files at a time."""

import pandas as pd

from themeloom.sources import word


class Files:
    """Stands for a table: hands one large batch to the function of mapInPandas."""

    columns = ["doc_id", "content"]

    class schema:
        def __class_getitem__(cls, name):
            class Field:
                class dataType:
                    simpleString = staticmethod(lambda: "int")

            return Field

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        return list(run(iter([pd.DataFrame({"doc_id": range(1000), "content": [b"not a file"] * 1000})])))


def test_blocks_come_few_files_at_a_time():
    found = word.word_blocks(Files())
    assert max(map(len, found)) <= 100
    whole = pd.concat(found)
    assert whole["doc_id"].tolist() == list(range(1000)) and whole["error"].notna().all()
