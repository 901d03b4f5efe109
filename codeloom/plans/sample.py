"""A small project, to try scans on, and the graph that it must give, worked out by hand."""

from __future__ import annotations

PROJECT = "shop"

SOURCES = {
    "app.py": """\
from store.item import Item
import helpers as h
from pydantic import BaseModel, Field


class App(BaseModel):
    size: int = Field(3)

    def __init__(self):
        self.item = Item()

    def run(self):
        return h.total(self.item)


def start():
    app = App()
    return h.total(app.run())
""",
    "helpers.py": """\
def total(item):
    return item.price


class Tool:
    def use(self):
        return total(1)
""",
    "store/__init__.py": "",
    "store/item.py": """\
import numpy as np


class Item:
    price = np.float64(1)
""",
}

#: node_type, qname, path, line_no, col_offset, end_line_no, end_col_offset, imported_paths
NODES = """
    ('project', 'shop', '', NULL, NULL, NULL, NULL, NULL),
    ('folder', 'store', 'store', NULL, NULL, NULL, NULL, NULL),
    ('file', 'app', 'app.py', NULL, NULL, NULL, NULL, NULL),
    ('file', 'helpers', 'helpers.py', NULL, NULL, NULL, NULL, NULL),
    ('file', 'store.__init__', 'store/__init__.py', NULL, NULL, NULL, NULL, NULL),
    ('file', 'store.item', 'store/item.py', NULL, NULL, NULL, NULL, NULL),
    ('class', 'app.App', 'app.py', 6, 0, 13, 33, NULL),
    ('function', 'app.App.__init__', 'app.py', 9, 4, 10, 26, NULL),
    ('function', 'app.App.run', 'app.py', 12, 4, 13, 33, NULL),
    ('function', 'app.start', 'app.py', 16, 0, 18, 29, NULL),
    ('function', 'helpers.total', 'helpers.py', 1, 0, 2, 21, NULL),
    ('class', 'helpers.Tool', 'helpers.py', 5, 0, 7, 23, NULL),
    ('function', 'helpers.Tool.use', 'helpers.py', 6, 4, 7, 23, NULL),
    ('class', 'store.item.Item', 'store/item.py', 4, 0, 5, 25, NULL),
    ('package', 'numpy', NULL, NULL, NULL, NULL, NULL, 'numpy.float64,numpy'),
    ('package', 'pydantic', NULL, NULL, NULL, NULL, NULL, 'pydantic.BaseModel,pydantic.Field')
"""

#: consumer, target, target_qname, target_symbol, alias, line_no, col_offset, end_col_offset, import_line
USES = """
    ('app.App', 'pydantic', 'pydantic.BaseModel', 'BaseModel', 'BaseModel', 6, 10, 19, 3),
    ('app.App', 'pydantic', 'pydantic.Field', 'Field', 'Field', 7, 16, 21, 3),
    ('app.App.__init__', 'store.item.Item', 'store.item.Item', 'Item', 'Item', 10, 20, 24, 1),
    ('app.App.run', 'helpers.total', 'helpers.total', 'total', 'h', 13, 15, 22, 2),
    ('app.App.run', 'helpers', 'helpers', 'h', 'h', 13, 15, 16, 2),
    ('app.start', 'helpers.total', 'helpers.total', 'total', 'h', 18, 11, 18, 2),
    ('app.start', 'helpers', 'helpers', 'h', 'h', 18, 11, 12, 2),
    ('store.item.Item', 'numpy', 'numpy.float64', 'float64', 'np', 5, 12, 22, 1),
    ('store.item.Item', 'numpy', 'numpy', 'np', 'np', 5, 12, 14, 1)
"""

#: consumer, target, line_no, col_offset of the calls of what the project declares
CALLS = """
    ('app.App.__init__', 'store.item.Item', 10, 20),
    ('app.App.run', 'helpers.total', 13, 15),
    ('app.start', 'app.App', 17, 10),
    ('app.start', 'helpers.total', 18, 11),
    ('app.start', 'app.App.run', 18, 19),
    ('helpers.Tool.use', 'helpers.total', 7, 15)
"""
