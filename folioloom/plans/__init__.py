"""Import stages, serving views, exports and the registered queries."""
