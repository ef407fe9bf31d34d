import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


#: A module with a docstring, imports, a constant, a guarded import, plain, decorated, async and nested
#: functions, a tiny class, and a class with a property and its setter.
SAMPLE = '''"""Shelves and what stands on them."""
import os
from sys import (
    argv,
)

LIMIT = 3

try:
    import zlib
except ImportError:
    zlib = None


def weigh(item: str = "pot") -> int:
    return len(item)


@staticmethod
@os.fspath
async def carry(things, *, twice: bool=False):
    """Carry things.

    Twice if asked to.
    """
    def inner():
        import json
        return json

    return inner()


class Tiny:
    pass


@os.fspath
class Shelf(dict, metaclass=type):
    """A shelf."""

    def __init__(self):
        self.n = 0

    @property
    def load(self):
        """What it bears."""
        return self.n

    @load.setter
    def load(self, n):
        self.n = n

    def text(self):
        return """
under
    over
"""


if __name__ == "__main__":
    print(LIMIT)
'''


@pytest.fixture(scope="session")
def sample():
    return SAMPLE
