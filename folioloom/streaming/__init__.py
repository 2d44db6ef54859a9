"""Pages that arrive as files, linked as they come."""

from .pages import FOLIO_PAGE, link_new_pages

__all__ = ["FOLIO_PAGE", "link_new_pages"]
