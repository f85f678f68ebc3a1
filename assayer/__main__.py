from assayer.cli import main

raise SystemExit(main())
