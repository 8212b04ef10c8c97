"""Column builders: pure ``Column -> Column`` functions shared by batch and stream operators."""
