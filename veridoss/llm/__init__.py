"""Training-data operators: ten corpus components, their queries and helpers.

Nothing outside this subpackage imports it; delete the folder and the rest of the
library still works.
"""
