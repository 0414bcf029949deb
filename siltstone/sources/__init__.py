"""Where logs come from and go to: views, the on-disk table, write-ahead log segments."""
