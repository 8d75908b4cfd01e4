"""The declarative language: text -> syntax tree -> plans of the engine."""
