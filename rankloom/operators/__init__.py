"""Models, features, composition, metrics, splits and tuning over interaction tables."""
