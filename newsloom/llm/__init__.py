"""Training-data operators: language, licences, pages, archives, duplicates, tokens, chats and shards."""
