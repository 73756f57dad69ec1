"""Reading tables and their metadata; append logs and what is read from them."""
