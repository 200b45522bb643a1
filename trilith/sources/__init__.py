from .tables import TABLES, read_table  # noqa: F401
from .items import ITEM_COLUMNS, ITEMS_SQL, item_view  # noqa: F401
