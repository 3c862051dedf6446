"""Column functions: everything here returns a Column and adds no shuffle."""
