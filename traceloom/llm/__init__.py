"""Operators of a training-data pipeline. `catalog` names their queries; nothing else in the library imports this package."""
